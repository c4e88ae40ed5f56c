"""quaystone: search-evidence analytics as named DataFrame operators on Spark."""
