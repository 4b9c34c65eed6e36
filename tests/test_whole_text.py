import hashlib
import re

import __spark_entry__ as contract


def test_queries_over_all_texts(spark, tmp_path):
    texts = {"s1": "收入 12 亿元", "s2": "Café  No 7\n", "s3": "Plain 3", "s4": None}
    spark.createDataFrame(list(texts.items()), "segment_id string, content string").write.parquet(str(tmp_path / "langqi_restatement_segments.parquet"))
    spark.createDataFrame([("e1", "恒珩材料"), ("e2", "Éclair"), ("e3", "Bram"), ("e4", None)], "entity_id string, canonical_name string").write.parquet(str(tmp_path / "resolved_entities.parquet"))
    spark.createDataFrame([("o1", "e1", "恒衡材料"), ("o2", "e2", "Eclair"), ("o3", "e3", "Bram")], "observation_id string, company_id string, company string").write.parquet(str(tmp_path / "metric_observations.parquet"))

    def run(name):
        return [tuple(r) for r in contract.queries()[name](spark, str(tmp_path)).collect()]

    key = {k: hashlib.md5(re.sub("[0-9]+", "#", re.sub(r"\s+", "", t.strip().lower())).encode()).hexdigest() for k, t in texts.items() if t}
    assert dict(run("c28_dedupe_key")) == key
    assert dict(run("a30_character_error_rate")) == {"o1": 0.25, "o2": round(1 / 6, 6), "o3": 0.0}
    assert sorted(run("o11_company_list"), key=lambda r: r[2]) == [("e3", "Bram", 1), ("e2", "Éclair", 2), ("e1", "恒珩材料", 3)]
