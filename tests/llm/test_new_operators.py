"""Ranked search, line rules and collocations against plain versions written anew here, on tables with edge cases."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import linerules, phrases, treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the of river town Évening wörd x1 and walk 7 boats".split()


def made_texts(n: int, seed: int, least: int = 0, most: int = 60) -> list[str]:
    rng = np.random.default_rng(seed)
    ends = [" ", " ", " ", ". ", ", ", "\n", "  ", "\t"]
    return ["".join(WORDS[min(10, int(rng.exponential(3)))] + ends[rng.integers(8)] for _ in range(rng.integers(least, most))) for _ in range(n)]


# ----------------------------------------------------------------- ranked search
def plain_rank(docs, items, k):
    cut = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    cut = [(i, t) for i, t in cut if t]
    n_all, total = len(cut), sum(len(t) for _, t in cut)
    df = Counter(x for _, t in cut for x in set(t))
    w = {x: math.floor(1000 * math.log((2.0 * n_all + 2) / (2.0 * c + 1))) for x, c in df.items()}
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(TERM.findall((t or "").translate(LOW)))
    out = set()
    for item, terms in asked.items():
        scored = []
        for i, t in cut:
            tf, m = Counter(t), 10 + (90 * len(t) * n_all) // total
            s = sum(w[x] * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in terms if x in tf)
            scored += [(-s, i is None, i)] if s else []
        out |= {(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)}
    return out


@pytest.fixture(scope="module")
def corpus():
    texts = made_texts(300, 5)
    rows = [(i * 7 % 301, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(40)] + [(2000, None), (2001, ""), (2002, "?!"), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[3]), (2003, " ".join(texts) * 3), (2004, "rare evening"), (2005, "Rare")]
    return rows


@pytest.mark.parametrize("postings", [60, 10**6])
def test_ranked_search_against_all_scores(spark, corpus, postings, monkeypatch):
    items = [(1, "the river"), (2, texts := "Rare TOWN, 7 boats and the evening"), (3, None), (4, ""), (5, "unseen"), (6, "walk"), (6, "boats walk"), (7, texts), (None, "river")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in corpus], "doc_id long, text string, rank int, term string").repartition(3)
    asked = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, score int")
    want = plain_rank(corpus, [x for x in items], treaps.K)
    assert {tuple(r) for r in treaps.rank(docs, asked, postings=postings).collect()} == want
    # many blocks of items over an index of all terms give the same
    monkeypatch.setattr(treaps, "TERMS", 4)
    assert {tuple(r) for r in treaps.rank(docs, asked, postings=postings).collect()} == want


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treaps.rank(docs.where("false"), items).count() == 0 and treaps.rank(docs, items.where("false")).count() == 0


def test_treaps_keep_both_orders_and_copies_make_no_chain():
    rng = np.random.default_rng(1)
    key = [(int(q) << 24) | int(p) for q, p in zip(np.repeat([5, 9], 2000), rng.integers(0, 1 << 24, 4000))]
    down, up = treaps.heaps([0, 1500], key)
    for a, b in ((0, 1500), (1500, 4000)):
        child = {c for x in (down[a:b], up[a:b]) for c in x if c >= 0}
        (root,) = set(range(b - a)) - child
        level, depth, seen = [(root, -1, b - a)], 0, 0
        while level:
            depth, seen, nxt = depth + 1, seen + len(level), []
            for i, lo, hi in level:
                assert lo < i < hi
                for c, x, y in ((down[a + i], lo, i), (up[a + i], i, hi)):
                    if c >= 0:
                        assert key[a + c] <= key[a + i]
                        nxt.append((c, x, y))
            level = nxt
        assert seen == b - a and depth < 60


def test_search_leaves_most_documents_unscored(spark):
    rng = np.random.default_rng(3)
    common, rows = ["the", "of", "and", "to"], []
    for i in range(4000):
        rows.append((i, " ".join([*rng.choice(common, 20), f"w{rng.integers(3000)}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    asked = treaps.item_terms(spark.createDataFrame([(1, "the and of " + " ".join(f"w{i}" for i in range(12)))], "item_id long, text string"))
    held = treaps.index(docs)
    found = treaps.search(held, asked, counted=True).collect()
    assert len(found) == 10 and max(r.scored for r in found) < 1000
    assert {tuple(r)[:4] for r in found} == plain_rank(rows, [(1, "the and of " + " ".join(f"w{i}" for i in range(12)))], 10)


# ----------------------------------------------------------------- line rules
BLANK = " \t\n\x0b\x0c\r"


def plain_rules(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    again = len({j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)})
    lines = [x for x in t.split("\n") if x.strip(BLANK)]

    def bad(x):
        end = x.rstrip(BLANK + "\"'”’»›)]}*_")
        seps, n, syms, low = sum(c in "|»›>•·/\\" for c in x), len([w for w in re.split(r"[\x20\x09-\x0D]+", x) if w]), sum(c in "#*$%&|<>" for c in x), x.lower()
        return not end or end[-1] not in ".!?:;…。！？।۔" or (seps >= 3 and seps * 6 >= n) or syms * 10 > len(x) or (len(x) >= 20 and x.upper() == x != low) or any(p in low for p in linerules.BOILERPLATE)

    good = [x for x in lines if not bad(x)]
    failed = len(words) < 50 or 100 * again > 50 * len(words)
    chars, lost = sum(map(len, lines)), sum(map(len, lines)) - sum(map(len, good))
    clean = None if text is None else "\n".join(good)
    return clean, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), again, failed, len(lines), len(lines) - len(good), lost, chars, not failed and 100 * lost <= 50 * chars


def test_line_rules_against_plain_rules(spark):
    body = " ".join(f"Word{i} of the town." for i in range(30))
    texts = [*made_texts(150, 8, 0, 200), None, "", "\n\n", " \t\x0b", "a b c a b c", "a a a a a", "one two three", "x", body, body + "\n" + body, "Home | News | About | Help\n" + body, "# * $ % &\n" + body, "SHOUTED LINE OF MANY WORDS HERE!\n" + body, "We use cookies here.\n" + body, "no end\n" * 40 + body, "Été fini »\r\n" + body + " ", "ends with (a word).)\"\n" + body, "日本語。\n" + body, " ".join(f"w{i % 7} q{i}" for i in range(30_000)) + ".", "same line again.\n" * 3000]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, _m int").repartition(3)
    got = {r.doc_id: r for r in linerules.clean(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.text, *(r[c] for c in linerules.ADDED)) == plain_rules(t), (i, (t or "")[:60])
        assert r._m == 1
    assert linerules.clean(df.where("false")).count() == 0


def test_line_rules_need_no_python_and_no_shuffle(spark):
    plan = linerules.clean(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# ----------------------------------------------------------------- collocations
def plain_collocations(rows, least, most, top, inside):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in held.items():
            if any(100 * b >= inside * a for q, b in held.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]]))
        out |= {(lang, i, p.decode(), a, x, y, n[lang], -s) for i, (s, _, p, a, x, y) in enumerate(sorted(best)[:top], 1)}
    return out


@pytest.mark.parametrize(("bits", "most", "top"), [(23, 3, 2000), (4, 4, 7), (12, 2, 30)])
def test_collocations_against_plain_counts(spark, bits, most, top):
    texts = made_texts(120, 11)
    langs = ["en", "de", None, "und"]
    rows = [(langs[i % 4], t) for i, t in enumerate(texts)] + [("en", None), ("en", ""), (None, "?!."), ("xx", "new york city hall " * 30), ("xx", "new york."), ("en", " ".join(texts))]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, n int, phrase string").repartition(3)
    assert {tuple(r) for r in phrases.collocations(df, 10, most, top, 50, bits).collect()} == plain_collocations(rows, 10, most, top, 50)
    assert phrases.collocations(df.where("false"), bits=bits).count() == 0


def test_score_of_phrases_is_exact_past_64_bits(spark):
    a, b = F.lit(3_000_000_019).cast("decimal(19,0)"), F.lit(4_000_000_007).cast("decimal(19,0)")
    got = spark.range(1).select(F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), b * b).alias("x")).first().x
    assert got == 1_000_000 * 3_000_000_019**2 // 4_000_000_007**2
