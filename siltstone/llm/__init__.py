"""Operations of a training-data pipeline, each a Spark job over a corpus table.

Nothing outside this subpackage imports it.
"""
