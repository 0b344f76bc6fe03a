import pyarrow as pa
from pyspark.sql import functions as F

from lumenfold.functions import text as fn
from lumenfold.operators import trigrams as tg

TEXTS = [None, "", "ab", "abc", "ABCabc", "né à l'ÉTÉ 𝒳𝒴𝒵z\n\r\nZ", "aaaaaaaaaa", "x" * 5 + "Ünï" * 3, "The Quevi treeleen"]


def test_trigrams_as_numbers_are_those_of_strings(spark):
    rows = spark.createDataFrame([(None if i == 3 else i % 7, t) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string")
    plain = rows.select("doc_id", F.explode(fn.trigrams(tg.folded("text"))).alias("gram")).where("length(gram) = 3")
    got = tg.grams(rows)
    assert got.columns == ["doc_id", "gram"] and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_a_task_holds_few_trigrams():
    texts = pa.RecordBatch.from_pydict({"row": list(range(40)), "text": [f"text {i} " * 50 for i in range(40)]})
    out = list(tg._gram_batches(iter([texts]), most=1000))
    assert len(out) > 10 and sum(x.num_rows for x in out) == sum(len({t[j : j + 3] for j in range(len(t) - 2)}) for t in texts.column("text").to_pylist())
