"""Observation analytics on Spark: as-of selection, comparison and exchange of observation ledgers."""
