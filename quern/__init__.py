"""PySpark-native document analytics: extraction, parsing, matching, scoring, merging."""
