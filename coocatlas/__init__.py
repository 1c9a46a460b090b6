"""Spark operators for co-occurrence catalogues: vocabulary, pairs, entities, maps, neighbours, read queries."""
