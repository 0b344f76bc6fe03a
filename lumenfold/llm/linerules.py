"""Quality rules applied line by line first, then to the document [DataFrame functions only].

A line with a word fails if it breaks one of four rules:

- punctuation: it doesn't end with closing punctuation (brackets and quotes may follow);
- navigation: three or more separators of menus and paths, at least one for each six words;
- boilerplate: it holds a phrase of BOILERPLATE, whatever the case of its letters;
- markup: more than a tenth of its characters are symbols, or it has 20 characters or more and its letters are all capitals.

Lines that fail are taken out. A document is rejected if its own counts fail (too few words, too many
words in repeated three-word windows) or if more than MOST_LOST % of the characters of its lines with
words went with the lines taken out.

Every document is decided from its own row: nothing is shuffled, and nothing leaves the JVM. The
words of a text and its windows are arrays of that row, about 200 bytes for each byte of the
longest text.

Defined results: a null text stays null and an empty one empty, both with zero counts and rejected
for too few words; repeated rows are decided alike; an empty table gives no rows; further columns
pass through, whatever their names, but columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

MIN_WORDS = 50
MOST_REPEATED = 50
MOST_LOST = 50

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?:;…。！？।۔"
BEHIND = BLANKS + "\"'”’»›)]}*_"
SEPARATORS = "|»›>•·/\\"
BOILERPLATE = (
    "javascript", "cookie policy", "use cookies", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "copyright ©", "licensed under", "lorem ipsum", "click here", "sign up", "log in",
    "skip to content", "read more", "subscribe to", "alle rechte vorbehalten", "datenschutzerklärung",
    "tous droits réservés", "mentions légales", "todos los derechos reservados", "aviso legal",
)
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "removed_lines", "lost_chars", "line_chars", "kept")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that occurs more than once.

    Only where two windows have one hash are they sorted by it, which makes equal ones neighbours; then their words are compared.
    """
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def same(x: Column, y: Column) -> Column:
        equal = x["h"] == y["h"]
        for k in range(3):
            equal = equal & (F.get(words, x["i"] + k) == F.get(words, y["i"] + k))
        return F.coalesce(equal, F.lit(False))

    def places(h: Column) -> Column:
        every = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(every, lambda rows: F.filter(rows, lambda x, j: same(x, F.get(rows, j - 1)) | same(x, F.get(rows, j + 1))))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    begin = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    step = lambda s, p: F.struct(p.alias("at"), (s["n"] + F.least(F.lit(3), p - s["at"])).alias("n"))
    covered = lambda h: F.aggregate(places(h), begin, step, lambda s: s["n"])
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))


def _holds(text: Column, parts: Iterable[str]) -> Column:
    found = F.lit(False)
    for x in parts:
        found = found | F.contains(text, F.lit(x))
    return found


def _one_of(characters: str) -> str:
    """The pattern of one of these characters."""
    return "[" + "".join("\\" + x if x in "\\]^-*$|" else x for x in characters) + "]"


def _count(text: Column, characters: str) -> Column:
    """How many of these characters text has; without one it is not searched for the others."""
    return F.when(_holds(text, characters), F.regexp_count(text, F.lit(_one_of(characters)))).otherwise(0)


def fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule. What costs least is asked first."""
    last = F.right(F.rtrim(line, F.lit(BEHIND)), F.lit(1))
    separators = let(_count(line, SEPARATORS), lambda n: (n >= 3) & (n * 6 >= F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))))
    markup = let(_count(line, SYMBOLS), lambda n: (n > 0) & (n * 10 > F.length(line)))
    low = F.lower(line)
    spoken = let(low, lambda x: _holds(x, BOILERPLATE))
    shouted = (F.length(line) >= 20) & (F.upper(line) == line) & (low != line)
    return ~last.isin(*ENDS) | separators | markup | shouted | spoken


def measure(text: Column) -> Column:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines, good): the last two are the lines with a word, and those of them that pass."""
    full = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        chars = F.length(F.array_join(words, ""))
        return F.struct(F.size(words).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), repeated_words(words).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("line_chars"),
            F.filter(lines, lambda x: ~fails(x)).alias("good"),
        )

    lines = F.filter(F.split(full, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    return F.struct(let(words_of(full), of_words).alias("words"), let(lines, of_lines).alias("lines"), _count(full, SYMBOLS).cast("long").alias("n_symbols"))


def clean(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED, most_lost: int = MOST_LOST) -> DataFrame:
    """docs with the failing lines (and lines without a word) taken out of text, and the columns of ADDED; rejected rows stay, marked by kept."""
    own = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), measure(F.col(f"`{text}`")).alias("_m"))
    m = F.col("_m")
    lost = m["lines"]["line_chars"] - F.aggregate(m["lines"]["good"], F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    n, repeated = m["words"]["n_words"], m["words"]["n_repeat_words"]
    failed = (n < min_words) | (repeated * 100 > n * most_repeated)
    out = rows.select(
        "_row", F.array_join(m["lines"]["good"], "\n").alias("_clean"), n.alias("n_words"), m["words"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["lines"]["n_dup_lines"].alias("n_dup_lines"), repeated.alias("n_repeat_words"), failed.alias("base_failed"), m["lines"]["n_lines"].alias("n_lines"),
        (m["lines"]["n_lines"] - F.size(m["lines"]["good"])).alias("removed_lines"), lost.alias("lost_chars"), m["lines"]["line_chars"].alias("line_chars"),
    )
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("line_chars") * most_lost)
    columns = [F.when(F.col(f"_row.`{c}`").isNotNull(), F.col("_clean")).alias(c) if c == text else F.col(f"_row.`{c}`") for c in own]
    return out.select(*columns, *ADDED[:-1], kept.alias("kept"))


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "removed_lines", "lost_chars", F.md5("text").alias("text_md5"))


_SYMBOLS, _SEPARATORS = _one_of(SYMBOLS), _one_of(SEPARATORS)
_BEHIND = r"""[\x20\x09-\x0D"''”’»›)\]}*_]"""
_PHRASES = " or ".join(f"contains(low, '{x}')" for x in BOILERPLATE)
OP12_SQL = rf"""
with docs as (
  select row_number() over () as r, doc_id, text, coalesce(text, '') as t from documents),
word as (
  select r, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') as w from docs),
gram as (
  select r, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'g': array_to_string(w[i:i + 2], ' '), 'i': i}})) as x from word where len(w) >= 3),
twice as (select r, x.i as i, count(*) over (partition by r, x.g) as n from gram),
again as (
  select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from twice where n > 1) group by r),
line as (
  select r, unnest(range(1, len(l) + 1)) as pos, unnest(l) as line from (select r, string_split(t, chr(10)) as l from docs)),
judged as (
  select r, pos, line, length(line) as chars, lower(line) as low,
         len(regexp_extract_all(line, '{_SYMBOLS}')) as symbols,
         len(regexp_extract_all(line, '{_SEPARATORS}')) as separators, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words
  from line where regexp_matches(line, '[^\x20\x09-\x0D]')),
marked as (
  select *, not regexp_matches(line, '[{ENDS}]{_BEHIND}*\z') or (separators >= 3 and separators * 6 >= words) or symbols * 10 > chars
            or (chars >= 20 and upper(line) = line and low <> line) or {_PHRASES} as bad
  from judged),
per as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines, count(*) filter (bad) as removed_lines,
         coalesce(sum(chars) filter (bad), 0) as lost, sum(chars) as all_chars, string_agg(line, chr(10) order by pos) filter (not bad) as good
  from marked group by r),
counted as (
  select d.doc_id, d.text, len(w) as n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) as word_chars,
         len(regexp_extract_all(t, '{_SYMBOLS}')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         coalesce(n_lines, 0) as n_lines, coalesce(removed_lines, 0) as removed_lines, coalesce(lost, 0) as lost, coalesce(all_chars, 0) as all_chars, good
  from docs d join word using (r) left join per using (r) left join again using (r)),
based as (select *, n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MOST_REPEATED} as base_failed from counted)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not base_failed and lost * 100 <= all_chars * {MOST_LOST} as kept, cast(n_lines as bigint) as n_lines, cast(removed_lines as bigint) as removed_lines,
       cast(lost as bigint) as lost_chars, case when text is not null then md5(coalesce(good, '')) end as text_md5
from based
"""
