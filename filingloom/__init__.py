"""filingloom: Spark-native analytics over facts, text and graphs drawn from filings."""
