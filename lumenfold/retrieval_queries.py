"""Registered queries on retrieval by stored trigrams, learned vectors and models, each with the SQL that checks it where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenfold.catalog import SPLIT, query, t
from lumenfold.operators import embedding as em
from lumenfold.operators import inference as inf
from lumenfold.operators import learned as le
from lumenfold.operators import search as se
from lumenfold.operators import trigrams as tg
from lumenfold.sources.store import cut, work_dir

PATTERN = "(quevi|treel+een).*en"
ALL_OF = " or ".join("(" + " and ".join(f"contains(f, '{g}')" for g in grams) + ")" for grams in (("que", "uev", "evi"), ("tre", "ree", "eel", "een")))


@query(f"""with d as (select doc_id, text, translate(text, '{tg.UPPER}', '{tg.LOWER}') as f from documents), l as (select doc_id, unnest({SPLIT}) as line from documents),
h as (select doc_id, count(*) as score from l where regexp_matches(line, '(?i){PATTERN}') group by 1)
select doc_id, score, (select count(*) from d where {ALL_OF}) as read from h order by h.score desc, doc_id limit 25""")
def regex_indexed(spark, d):
    """The documents with most lines that match a pattern, from stored trigrams; read: how many texts were read for it."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    index = tg.TrigramIndex(spark, f"{work_dir(spark)}/trigrams-{uuid.uuid4().hex}").build(docs)
    read = cut(index.texts(docs, PATTERN))
    found = se.regex_search(read, PATTERN, 25).select("doc_id", "score")
    return found.crossJoin(F.broadcast(read.agg(F.count("*").alias("read"))))  # one row


def shared_words():
    """A stand-in for a model of pairs: the share of a text's distinct words that the query has."""

    def score(queries, texts):
        a, b = ([set(x.split(" ")) for x in xs] for xs in (queries, texts))
        return [len(x & y) / len(y) for x, y in zip(a, b, strict=True)]

    return score


@query("""with q as (select conv_id, arg_min(text, turn) as query, min(turn) as first from conversations where role = 'user' group by 1),
p as (select conv_id, turn, list_distinct(string_split(query, ' ')) as a, list_distinct(string_split(substring(text, 1, 500), ' ')) as b from conversations join q using (conv_id) where turn > first),
s as (select conv_id, turn, len(list_intersect(a, b))::double / len(b) as score from p)
select conv_id, row_number() over (partition by conv_id order by s.score desc nulls last, turn) as rank, turn, round(score, 9) as score from s
qualify row_number() over (partition by conv_id order by s.score desc nulls last, turn) <= 3""")
def rerank_all(spark, d):
    """Each conversation's three later turns that a model of pairs puts nearest to its first question."""
    rows = t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    first = rows.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"), F.min("turn").alias("first"))
    found = inf.rerank(rows.join(first, "conv_id").where("turn > first"), shared_words, 3, "conv_id", "turn", text="text")
    return found.select("conv_id", "rank", "turn", F.round("score", 9).alias("score"))


@query("""with w as (select doc_id, unnest(t) as tok, unnest(range(len(t))) as p from (select doc_id, list_transform(regexp_extract_all(text, '[a-z]+|[A-Z][a-z]*|[0-9]+'), lambda x: lower(x)) as t from documents)),
voc as (select tok, count(*) as c from w group by 1 having c >= 3 order by c desc, tok limit 20000), k as (select w.* from w join voc using (tok)),
ab as (select a.tok as a, b.tok as b, sum(6 - g) as n from (select *, unnest(range(1, 6)) as g from k) a join k b on a.doc_id = b.doc_id and b.p = a.p + g group by all),
m as (select a, b, sum(n) as n from (select a, b, n from ab union all select b, a, n from ab) group by all), s as (select a, sum(n) as s from m group by 1),
v as (select m.a, m.b, m.n, ln(m.n::double * (select sum(s) from s) / (x.s::double * y.s)) as v from m join s x on x.a = m.a join s y on y.a = m.b where m.a <= m.b and m.n >= 50)
select a, b, cast(n as bigint) as n, round(v, 6) as information from v where v > 0 order by round(v.v, 6) desc, a, b limit 200""")
def token_associations(spark, d):
    """The 200 pairs of tokens near each other, at least 50 times by weight, that tell most of one another."""
    docs = t(spark, d, "documents")
    tokens = [x for x, _ in le.vocabulary(docs)]
    rows = le.information(cut(le.cooccurrences(docs, tokens))).where("n >= 50")
    names = F.broadcast(spark.createDataFrame(list(enumerate(tokens)), "i int, tok string"))  # the vocabulary
    rows = rows.join(names.withColumnRenamed("tok", "a"), "i").join(names.select(F.col("i").alias("j"), F.col("tok").alias("b")), "j").where("a <= b")
    return rows.select("a", "b", "n", F.round("v", 6).alias("information")).orderBy(F.desc("information"), "a", "b").limit(200)


@query()
def learned_topk(spark, d):
    """The ten documents nearest to a query, by vectors learned from all of them."""
    docs = t(spark, d, "documents")
    model = le.learn(docs)
    rows = docs.where("text is not null").select("doc_id", em.embed("text", model).alias("embedding"))
    return se.vector_top(rows, em.embed_query("the town and the river", model), 10, "doc_id").select("doc_id", F.round("score", 5).alias("score"))
