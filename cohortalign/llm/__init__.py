"""Training-data operators. Nothing else in the library imports this subpackage.

``queries()`` and ``oracle_sql()`` are what ``__spark_entry__`` registers.
"""


def _modules():
    from . import (decontaminate, embeddings, html_text, langid, lines, mixing, pipeline, negatives, resample, simhash,
                   suffix_dedup, toxicity, url_rules, warc)

    return [suffix_dedup, html_text, warc, simhash, mixing, langid, embeddings, decontaminate, lines,
            url_rules, resample, toxicity, negatives, pipeline]


def queries():
    from .common import keeps_batch_size

    out = {}
    for m in _modules():
        out.update({name: keeps_batch_size(query) for name, query in m.QUERIES.items()})
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update(m.ORACLE_SQL)
    return out
