from lumenfold.operators import search as se


def test_terms_are_counted_without_postings(spark, monkeypatch):
    rows = [(1, "The the cat2 THE"), (2, "a Cat\nthe"), (3, None), (4, ""), (5, "dog dog 12")]
    monkeypatch.setattr(se, "postings", None)  # only rows that share a key need them
    got = {r.tok: (r.df, r.cf) for r in se.terms(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {"the": (2, 3), "cat": (2, 2), "2": (1, 1), "t": (1, 1), "h": (1, 1), "e": (1, 1), "a": (1, 1), "dog": (1, 2), "12": (1, 1)}


def test_rows_that_share_a_key_are_one_document(spark):
    rows = [(1, "the cat"), (1, "the dog"), (None, "the"), (None, "the the"), (2, "the end")]
    got = {r.tok: (r.df, r.cf) for r in se.terms(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {"the": (3, 6), "cat": (1, 1), "dog": (1, 1), "end": (1, 1)}
