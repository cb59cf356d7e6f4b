"""The registered query of corpus_pipeline.py, which stands at the repository's top."""


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
ORACLE_SQL = {}
