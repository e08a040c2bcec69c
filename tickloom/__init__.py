"""tickloom: analytics over market, filings and news data as Spark DataFrame operators."""
