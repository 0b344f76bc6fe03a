"""Duplicates, differences, graphs and window-shaped operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import text as fn
from lumenfold.sources.store import cut as store_cut

# Names and prefixes that count as always reachable, and the weights of a hotspot.
ENTRY_NAMES = (
    "main", "__init__", "__new__", "__del__", "__str__", "__repr__", "__enter__", "__exit__", "__call__", "__getattr__", "__setattr__",
    "__getitem__", "__setitem__", "__len__", "__iter__", "__next__", "__eq__", "__hash__", "__lt__", "__le__", "__gt__", "__ge__",
    "__add__", "__sub__", "__mul__", "__truediv__", "setUp", "tearDown", "setUpClass", "tearDownClass", "setup_method", "teardown_method",
    "create_plugin",
)
ENTRY_PREFIXES = ("test_", "Test")
HOTSPOT_WEIGHTS = {"complexity": 0.30, "duplication": 0.20, "fan_in": 0.15, "fan_out": 0.15, "churn": 0.20}


# ----------------------------------------------------------------- duplicates
def duplicates(bodies: DataFrame, threshold: float = 0.75, min_lines: int = 4, key: str = "id", body: str = "body", apart: str | None = None, cut=store_cut) -> DataFrame:
    """(a, b, similarity) for pairs with trigram Jaccard of at least threshold; with `apart`, only across its values.

    A row's trigrams are one array from the rarest to the most frequent. An equi-join on the prefix of rare ones that a pair this
    similar must share keeps a pair only if what both have left after the shared trigram can still reach the threshold; the
    arrays are met again for such pairs alone.
    """
    text = fn.normal_body(body)
    rows = bodies.select(F.col(key).alias("k"), text.alias("t"), (F.col(apart) if apart else F.lit(None)).alias("g")).where(F.size(F.split("t", "\n")) >= min_lines)
    grams = rows.where("t <> ''").select("k", "g", F.explode(fn.trigrams("t")).alias("x"))
    common = grams.groupBy("x").agg(F.count("*").alias("f"))
    by_rarity = F.sort_array(F.collect_set(F.struct("f", "x")))
    held = cut(grams.join(common, "x").groupBy("k").agg(F.first("g").alias("g"), F.transform(by_rarity, lambda r: r["x"]).alias("xs")))
    n = F.size("xs")
    # the small amount keeps a product that rounding lifts above a whole number from shortening the prefix
    lead = F.slice("xs", 1, (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    prefix = held.select("k", "g", n.alias("n"), F.posexplode(lead).alias("p", "x"))
    side = lambda c: prefix.select(F.col("k").alias(c), F.col("g").alias(f"g{c}"), "x", F.col("n").alias(f"n{c}"), F.col("p").alias(f"p{c}"))
    pairs = side("a").join(side("b"), "x").where("a < b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    # places count from 0, so the shared trigram is among what is left
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    pairs = pairs.where(reach >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-6)
    pairs = (pairs.where("ga <> gb") if apart else pairs).select("a", "b").distinct()
    both = pairs.join(held.select(F.col("k").alias("a"), F.col("xs").alias("xa")), "a").join(held.select(F.col("k").alias("b"), F.col("xs").alias("xb")), "b")
    both = both.withColumn("c", F.size(F.array_intersect("xa", "xb")))
    return both.select("a", "b", (F.col("c") / (F.size("xa") + F.size("xb") - F.col("c"))).alias("similarity")).where(F.col("similarity") >= threshold)


def duplicate_classes(bodies: DataFrame, threshold: float = 0.75, min_lines: int = 4, key: str = "id", body: str = "body", apart: str | None = None, cut=store_cut) -> DataFrame:
    """(a, b, similarity) as duplicates(), but rows of equal body (and equal `apart`) are one class under its smallest key.

    Pairs are between classes; each further member b of a class a is one row of similarity 1, so copies cost a row each, not a pair each.
    """
    g = [F.col(apart).alias("g")] if apart else []
    rows = bodies.select(F.col(key).alias("k"), F.col(body).alias("body"), *g, fn.normal_body(body).alias("t")).where(F.size(F.split("t", "\n")) >= min_lines)
    rows = cut(rows.select("k", "body", F.sha2("t", 256).alias("h"), *(["g"] if apart else [])))
    by = ["h", "g"] if apart else ["h"]
    classes = cut(rows.groupBy(*by).agg(F.min("k").alias("rep"), F.min_by("body", "k").alias("body")))
    pairs = duplicates(classes, threshold, min_lines, "rep", "body", "g" if apart else None, cut)
    member = rows.select("k", *by).join(classes.select("rep", *by), by).where("k <> rep")
    return pairs.unionByName(member.select(F.col("rep").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("similarity")))


LEAD = 4
SMALL_BYTES, GRAM = 4 << 20, 3


def _small(leads: DataFrame) -> bool:
    """Whether a table of leads may be sent to every task."""
    texts = [c for c in ("lead", "passage") if c in leads.columns]
    return leads.agg(F.coalesce(F.sum(sum((F.length(c) for c in texts), F.lit(32))), F.lit(0)).alias("n")).first().n <= SMALL_BYTES


def contained(texts: DataFrame, passages: DataFrame, key: str, item: str, text: str = "text") -> DataFrame:
    """(key, item) of the passages that stand in a text as they are.

    Candidates share a run of LEAD words, the second to the fifth of the passage; then the text decides. The runs of the passages, if
    they are small, filter those of the texts before anything is shuffled. Shorter passages are sought by their longest inner word, or
    by their first characters where they have none.
    """
    words = lambda c: F.split(fn.stripped(F.regexp_replace(c, r"\\s+", " ")), " ")
    items = passages.select(F.col(item).alias("item"), F.col(text).alias("passage")).where("passage is not null").withColumn("w", words("passage"))
    docs = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    long_ = items.where(F.size("w") >= LEAD + 2).select("item", "passage", F.concat_ws(" ", F.slice("w", 2, LEAD)).alias("lead"))
    inner = F.expr("slice(w, 2, greatest(0, size(w) - 2))")
    brief = items.where(F.size("w") < LEAD + 2).select("item", "passage", F.reduce(inner, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)).alias("lead"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - LEAD + 1)), lambda i: F.concat_ws(" ", F.slice("w", i, F.lit(LEAD))))
    near = None
    for wanted, pieces in ((long_, runs), (brief.where("lead <> ''"), F.col("w"))):
        leads = wanted.select("item", "lead")
        if leads.isEmpty():
            continue
        found = docs.withColumn("w", words("text")).select("key", F.explode(F.array_distinct(pieces)).alias("lead")).join(F.broadcast(leads) if _small(leads) else leads, "lead").select("key", "item").distinct()
        near = found if near is None else near.unionByName(found)
    out = docs.select("key", F.lit(None).cast(items.schema["item"].dataType).alias("item")).where("false")
    if near is not None:
        out = near.join(items.select("item", "passage"), "item").join(docs, "key").where(F.contains("text", F.col("passage"))).select("key", "item")
    # what has no inner word is sought by its first characters, which every text that holds it has somewhere
    bare = brief.where("lead = ''").select("item", "passage", F.least(F.lit(GRAM), F.length("passage")).alias("n")).withColumn("lead", F.expr("left(passage, n)"))
    for n in sorted(r.n for r in bare.select("n").distinct().collect()):  # 0 to GRAM
        leads = bare.where(F.col("n") == n).select("item", "passage", "lead")
        letters = docs.withColumn("c", F.split("text", ""))
        grams = F.transform(F.sequence(F.lit(0), F.size("c") - n), lambda i: F.concat(F.lit(""), *[F.get("c", i + k) for k in range(n)]))  # noqa: B023
        held = letters.where(F.size("c") >= n).select("key", F.explode(F.array_distinct(grams)).alias("lead"))
        near = held.join(F.broadcast(leads) if _small(leads) else leads, "lead").select("key", "item", "passage")
        out = out.unionByName(near.join(docs, "key").where(F.contains("text", F.col("passage"))).select("key", "item"))
    return out.distinct().toDF(key, item)


# ----------------------------------------------------------------- differences
def changes(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """(key, change): created, modified or deleted."""
    both = old.select(key, F.col(digest).alias("o")).join(new.select(key, F.col(digest).alias("n")), key, "full_outer")
    kind = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified")
    return both.select(key, kind.alias("change")).where("change is not null")


def has_changed(current: DataFrame, stored: DataFrame, key: str, digest: str = "content_hash") -> DataFrame:
    return current.join(stored.select(key, F.col(digest).alias("_s")), key, "left").where(~F.col(digest).eqNullSafe(F.col("_s"))).drop("_s")


def replace_rows(stored: DataFrame, fresh: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """stored without the keys of fresh and gone, and fresh."""
    out = gone.select(key).unionByName(fresh.select(key)).distinct()
    return stored.join(out, key, "left_anti").unionByName(fresh)


def diff_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, name, old_name) of two symbol tables (name, body): renames are equal bodies without their first line."""
    inner = lambda b: fn.normal_body(F.when(F.contains(b, F.lit("\n")), F.expr("substring(body, instr(body, '\n') + 1)")).otherwise(b))
    side = lambda t: t.select("name", "body", inner(F.col("body")).alias("core"))
    o, n = side(old), side(new)
    j = o.select("name", F.col("body").alias("ob"), F.col("core").alias("oc")).join(n.select("name", F.col("body").alias("nb"), F.col("core").alias("nc")), "name", "full_outer")
    kept = j.where("ob is not null and nb is not null and ob <> nb")
    kind = F.when(fn.signature("ob") != fn.signature("nb"), "signature_changed").when(fn.normal_body("ob") == fn.normal_body("nb"), "cosmetic").otherwise("body_changed")
    same = kept.select(kind.alias("change"), "name", F.lit(None).cast("string").alias("old_name"))
    gone, come = j.where("nb is null").select("name", F.col("oc").alias("core")), j.where("ob is null").select("name", F.col("nc").alias("core"))
    nth = lambda t: t.withColumn("i", F.row_number().over(Window.partitionBy("core").orderBy("name")))
    moved = nth(gone).withColumnRenamed("name", "old_name").join(nth(come), ["core", "i"]).where("core <> ''").select("old_name", "name")
    added = come.join(moved.select("name"), "name", "left_anti").select(F.lit("added").alias("change"), "name", F.lit(None).cast("string").alias("old_name"))
    removed = gone.join(moved.select(F.col("old_name").alias("name")), "name", "left_anti").select(F.lit("removed").alias("change"), "name", F.lit(None).cast("string").alias("old_name"))
    return same.unionByName(added).unionByName(removed).unionByName(moved.select(F.lit("renamed").alias("change"), "name", "old_name"))


# ----------------------------------------------------------------- graphs
def call_edges(symbols: DataFrame, calls=None) -> DataFrame:
    """(caller, callee, file_path): called names that are known callables, by one equi-join; calls is the column of called names, by pattern if none is given."""
    able = symbols.where(F.col("kind").isin("function", "method"))
    each = able.select("file_path", "name", (fn.calls("body") if calls is None else calls).alias("called")).groupBy("file_path", "name")
    used = each.agg(F.array_distinct(F.flatten(F.collect_list("called"))).alias("called")).select("file_path", "name", F.explode("called").alias("callee"))
    # the names are the smaller side; sorting the calls instead would hold them all
    known = able.select(F.col("name").alias("callee")).distinct().hint("shuffle_hash")
    return used.where("callee <> name").join(known, "callee", "left_semi").select(F.concat_ws(":", "file_path", "name").alias("caller"), "callee", "file_path")


def callers_of(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("callee") == name)


def callees_of(edges: DataFrame, key: str) -> DataFrame:
    """Edges of one caller, file:name; of all callers of a name where there is no file."""
    return edges.where(F.col("caller") == key if ":" in key else F.endswith("caller", F.lit(f":{key}")))


def call_graph(edges: DataFrame, name: str) -> DataFrame:
    """Edges into and out of a name, with side."""
    return callers_of(edges, name).withColumn("side", F.lit("caller")).unionByName(callees_of(edges, name).withColumn("side", F.lit("callee")))


def graph_size(edges: DataFrame) -> DataFrame:
    """(edges, nodes): distinct names over both ends."""
    ends = edges.select(F.explode(F.array("caller", "callee")).alias("node"))
    return ends.agg((F.count("*") / 2).cast("long").alias("edges"), F.countDistinct("node").alias("nodes"))


def trace(symbols: DataFrame, edges: DataFrame, target: str, depth: int = 5, cut=store_cut) -> DataFrame:
    """(name, file_path, kind, depth) along the calls of target: callers at negative depths, callees at positive ones.

    Upwards a name is met once, downwards a key file:name, at its least distance; where a name has several symbols the first by file stands for it.
    """
    spark = symbols.sparkSession
    named = symbols.where("kind <> 'import'").groupBy("name").agg(F.min(F.struct("file_path", "start_line", "kind")).alias("s"))
    named = cut(named.select("name", "s.file_path", "s.kind", F.concat_ws(":", "s.file_path", "name").alias("key")))
    edges = cut(edges.select("caller", "callee"))  # every step reads them
    up = edges.select(F.col("callee").alias("src"), F.element_at(F.split("caller", ":"), -1).alias("dst"))
    down = edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    above = reach(up, spark.createDataFrame([(target,)], "node string"), depth, cut).where("depth > 0")
    below = reach(down, named.where(F.col("name") == target).select(F.col("key").alias("node")), depth, cut, named.select(F.col("name").alias("dst"), F.col("key").alias("node"))).where("depth > 0")
    return above.join(named, above.node == named.name).select("name", "file_path", "kind", (-F.col("depth")).alias("depth")).unionByName(
        below.join(named, below.node == named.key).select("name", "file_path", "kind", "depth")
    )


def trace_size(traced: DataFrame) -> DataFrame:
    """One row: how many symbols a trace met above and below its target, and together; the target doesn't count."""
    many = lambda cond: F.count(F.when(cond, 1))
    return traced.agg(many(F.col("depth") < 0).alias("upstream"), many(F.col("depth") > 0).alias("downstream"), many(F.col("depth") != 0).alias("total_nodes"))


def impact_size(reached: DataFrame) -> DataFrame:
    """One row: how many nodes are reached in one step, in more, and together; the seeds don't count."""
    many = lambda cond: F.count(F.when(cond, 1))
    return reached.agg(many(F.col("depth") == 1).alias("direct"), many(F.col("depth") > 1).alias("transitive"), many(F.col("depth") > 0).alias("total_affected"))


# ----------------------------------------------------------------- dependencies
# Import texts that lead into another language, in the order in which they are tried.
FOREIGN = (
    ("pyo3", "rust"), ("ctypes", "cpp"), ("cffi", "cpp"), ("WebAssembly", "rust"), (".wasm", "rust"), ("native ", "cpp"), ("System.loadLibrary", "cpp"),
)


def dependencies(symbols: DataFrame) -> DataFrame:
    """(source_file, import_text, line) of each import."""
    return symbols.where("kind = 'import'").select(F.col("file_path").alias("source_file"), fn.stripped("body").alias("import_text"), F.col("start_line").alias("line"))


def dependents(deps: DataFrame, module: str) -> DataFrame:
    """Imports whose text holds the module's name."""
    return deps.where(F.contains("import_text", F.lit(module)))


def polyglot(deps: DataFrame, foreign: tuple[tuple[str, str], ...] = FOREIGN) -> DataFrame:
    """Imports that lead into another language: the first of the texts that an import holds tells which."""
    own = F.coalesce(fn.grammar_of("source_file"), F.lit("unknown"))
    there = F.coalesce(*[F.when(F.contains(F.lower("import_text"), F.lit(text.lower())), lang) for text, lang in foreign])
    return deps.withColumns({"source_language": own, "target_language": there}).where("target_language <> source_language")


def cross_language_edges(symbols: DataFrame, foreign: tuple[tuple[str, str], ...] = FOREIGN) -> DataFrame:
    """(source_file, import_text, source_language, target_symbol, target_language, target_file): names of the other language that an import holds.

    Joined on the words of the import, not by comparing all imports with all names.
    """
    far = polyglot(dependencies(symbols), foreign)
    words = far.withColumn("target_symbol", F.explode(F.array_distinct(F.regexp_extract_all("import_text", F.lit(r"[A-Za-z_]\w*"), 0))))
    named = symbols.where("kind <> 'import'").select(F.col("name").alias("target_symbol"), F.col("file_path").alias("target_file"), fn.grammar_of("file_path").alias("target_language"))
    named = named.groupBy("target_symbol", "target_language").agg(F.max("target_file").alias("target_file"))
    return words.join(named, ["target_symbol", "target_language"]).select("source_file", "import_text", "source_language", "target_symbol", "target_language", "target_file")


def universal_edges(edges: DataFrame, cross: DataFrame) -> DataFrame:
    """Call edges of each language and the edges between languages as one graph."""
    over = cross.select(F.concat_ws(":", "source_file", "import_text").alias("caller"), F.col("target_symbol").alias("callee"), F.col("source_file").alias("file_path"))
    return edges.unionByName(over)


def dead_code(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions, methods and classes that nothing calls or mentions outside their own body."""
    able = symbols.where(F.col("kind").isin("function", "method", "class"))
    entry = F.col("name").isin(*ENTRY_NAMES) | F.col("name").startswith(ENTRY_PREFIXES[0]) | F.col("name").startswith(ENTRY_PREFIXES[1]) | F.col("name").rlike("^_.*_$")
    said = symbols.select("file_path", F.col("name").alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0))).alias("name"))
    others = said.where("own <> name").select("name").distinct()
    return able.where(~entry).join(edges.select(F.col("callee").alias("name")).distinct(), "name", "left_anti").join(others, "name", "left_anti")


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 5, cut=store_cut, places: DataFrame | None = None) -> DataFrame:
    """(node, depth) of the nodes first met at each step along edges (src, dst) from seeds (node); each frontier is written once, an empty one ends the search.

    Where edges lead to something else than nodes, places (dst, node) tells the nodes.
    """
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src").select("dst").distinct()
        step = step.withColumnRenamed("dst", "node") if places is None else step.join(places, "dst").select("node").distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def hotspots(symbols: DataFrame, fan_in: DataFrame | None, fan_out: DataFrame | None, dup: DataFrame, churn: DataFrame | None, k: int) -> DataFrame:
    """Weighted score of symbols (key, name, file_path, complexity); without churn its weight is spread over the others.

    Where fan_in and fan_out are None they are columns of symbols.
    """
    w = dict(HOTSPOT_WEIGHTS)
    if churn is None:
        spread = w.pop("churn") / len(w)
        w = {x: v + spread for x, v in w.items()}
    for fan in (fan_in, fan_out):
        symbols = symbols if fan is None else symbols.join(fan, "key", "left")
    j = symbols.join(dup, "file_path", "left")
    j = j.join(churn, "file_path", "left") if churn is not None else j
    j = j.fillna(0, [x for x in w if x in j.columns])
    most = j.agg(*[F.max(x).alias(f"m_{x}") for x in w])
    score = sum((v * fn.normalised(x, f"m_{x}") for x, v in w.items()), F.lit(0.0)) * 100
    return j.crossJoin(F.broadcast(most)).select("key", F.round(score, 2).alias("score")).orderBy(F.desc("score"), "key").limit(k)


# ----------------------------------------------------------------- windows
def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def newest(rows: DataFrame, n: int, *order, by: list[str] | None = None) -> DataFrame:
    """The first n rows by order; of each group where by is given."""
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def within_budget(rows: DataFrame, budget: int, by: list[str], order: list, text: str = "text") -> DataFrame:
    """The prefix of each group whose estimated tokens fit the budget; the first row always stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    used = F.sum(fn.token_estimate(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).withColumn("_r", F.row_number().over(w)).where((F.col("used") <= budget) | (F.col("_r") == 1)).drop("_r")


def uncovered(lengths: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, start_line, end_line): runs of the lines 1 to n of lengths (key, n) that no span (key, start_line, end_line) covers.

    Gaps between the spans in order, so no line is a row of its own: each span tells how far those before it reach.
    """
    ends = lengths.select(key, (F.col("n") + 1).alias("start_line"), (F.col("n") + 1).alias("end_line"), "n")
    every = spans.select(key, "start_line", "end_line", F.lit(None).cast("int").alias("n")).unionByName(ends)
    before = F.max("end_line").over(Window.partitionBy(key).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1))
    last = F.max("n").over(Window.partitionBy(key))
    gaps = every.select(key, (F.coalesce(before, F.lit(0)) + 1).alias("a"), F.least(F.col("start_line") - 1, last).alias("b"))
    return gaps.where("a <= b").select(key, F.col("a").alias("start_line"), F.col("b").alias("end_line"))


def sessions(events: DataFrame, who: str, ts: str, ttl: str = "3600 seconds", order: tuple[str, ...] = ()) -> DataFrame:
    """events with session number; a gap of exactly the time to live keeps the session. order breaks ties in time."""
    w = Window.partitionBy(who).orderBy(ts, *order)
    new = F.when(F.col(ts) > F.lag(ts).over(w) + F.expr(f"interval {ttl}"), 1).when(F.lag(ts).over(w).isNull(), 1).otherwise(0)
    return events.withColumn("_n", new).withColumn("session", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def trend(points: DataFrame, value: str, ts: str, by: list[str], flat: float = 0.01, higher_is_better: bool = True) -> DataFrame:
    """First, last and slope of a measure over time, and whether it improves; a change below the fraction flat is none."""
    span = (F.max_by(value, ts) - F.min_by(value, ts)).alias("delta")
    out = points.groupBy(*by).agg(F.min_by(value, ts).alias("first"), F.max_by(value, ts).alias("last"), span, F.coalesce(F.regr_slope(value, ts), F.lit(0.0)).alias("slope"))
    rate = F.col("delta") / F.greatest(F.abs("first"), F.lit(1e-9)) * (1 if higher_is_better else -1)
    return out.withColumn("direction", F.when(rate >= flat, "improving").when(rate <= -flat, "degrading").otherwise("stable"))
