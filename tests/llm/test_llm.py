import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netaccess.llm import chat, decontaminate, langid, mixing, neardup, quality, secrets, sharding, topk, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source) as documents."""
    return spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], DOCS)


def prose(rng, n=60):
    return " ".join(rng.choice(["the", "of", "river", "stone", "house", "quick", "brown", "tree", "walk", "seven"]) + rng.choice(["", "s", "ing", "."]) for _ in range(n))


ODD = [(1, None, "en", "a"), (2, "", None, None), (3, "   \n\t", "en", "a"), (4, "word", None, "b"), (4, "word", None, "b"), (None, "no id here", "en", None), (7, "x " * 30_000, "en", "a")]


# --- top-k


def brute_top_k(q_ids, Q, ids, V, k):
    out = []
    for a, q in zip(q_ids, Q, strict=True):
        scores = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i) for i, v in zip(ids, V, strict=True) if i != a)
        out += [(a, i, -s) for s, i in scores[:k]]
    return sorted(out)


@pytest.mark.parametrize("n,dims,spread", [(5, 3, 4), (300, 4, 2), (700, 2, 50), (400, 3, 10**8)])
def test_threshold_search_is_exact(n, dims, spread):
    rng = random.Random(n)
    V = [[rng.randint(-spread, spread) for _ in range(dims)] for _ in range(n)]
    ids = list(range(n))
    assert sorted(r[:3] for r in topk.threshold_search(ids[::20], V[::20], ids, V, 10)) == brute_top_k(ids[::20], V[::20], ids, V, 10)


def test_scores_beyond_a_long_rank_exactly():
    big = 2**62
    got = topk.threshold_search([0], [[big]], [0, 1, 2], [[1], [big], [big - 1]], 2)
    assert [r[:3] for r in got] == [(0, 1, topk.LONG), (0, 2, topk.LONG)]


def test_walks_stop_by_the_threshold():
    rng = np.random.default_rng(5)
    V = rng.integers(0, 1000, (5000, 8)) // np.array([1, 2, 4, 8, 16, 32, 64, 128])  # later dimensions weigh little
    got = topk.threshold_search(range(10), list(V[:10]), range(5000), list(V), 3)
    walks = {q: (scored, stopped) for q, _, _, scored, stopped in got}
    assert len(walks) == 10 and all(stopped and scored < 2500 for scored, stopped in walks.values())
    wanted = [x for q in range(10) for x in brute_top_k([q], V[[q]].tolist(), list(range(5000)), V.tolist(), 3)]
    assert sorted(r[:3] for r in got) == sorted(wanted)


def test_no_result_without_the_lists(monkeypatch):
    """The walk alone finds results: with lists that show one vector only, only that one is found."""
    V = [[i, 1] for i in range(50)]
    made = topk.Lists.__init__

    def one_vector(self, ids, vectors):
        made(self, ids, vectors)
        self.order[:] = 7

    monkeypatch.setattr(topk.Lists, "__init__", one_vector)
    assert {r[1] for r in topk.threshold_search([0], [V[3]], range(50), V, 5)} == {7}


def test_top_k_odd_rows(spark):
    rows = [(0, [0.5, 0.25]), (0, [0.5, 0.25]), (100, [float("nan"), 1.0]), (101, None), (102, [1.0, None]), (103, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>").where(topk.usable(F.col("e")))
    v = df.select(F.col("vec_id").alias("id"), topk.quantised(F.col("e")).alias("v"))
    got = topk.exact_top_k(v, v.where("id % 100 = 0"), block=2, query_block=1).orderBy("rank").collect()
    assert [tuple(r)[:4] for r in got] == [(0, 1, 5, 786432), (0, 2, 6, 786432)]
    assert {r["scored"] for r in got} == {2}
    assert topk.exact_top_k(v.limit(0), v.limit(0)).count() == 0


# --- language


def test_language_held_out_and_odd_rows(spark):
    rng = random.Random(1)
    words = {"en": "the and that with from house river".split(), "de": "der und das nicht schön über haus".split()}
    rows = [(i, " ".join(rng.choices(words[l], k=20)), l, "s") for i in range(80) for l in [rng.choice(["en", "de"])]]
    d = docs_of(spark, [*rows, *ODD, (900, "12345 !!", None, "s")])
    got = {r["doc_id"]: r for r in langid.identify(d, d.where("doc_id < 50"), {"doc_id": F.col("doc_id")}).collect()}
    assert all(got[i]["lang_pred"] == l for i, _, l, _ in rows if i not in (1, 2, 3, 4, 7))
    assert got[1]["lang_pred"] == got[900]["lang_pred"] == "und" and got[900]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.identify(d, d.limit(0), {"doc_id": F.col("doc_id")}).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    assert langid.identify(d.limit(0), d, {"doc_id": F.col("doc_id")}).count() == 0


def test_encoder_equals_definition():
    e = langid.Encoder(64)
    text = "Añb  c!d"
    v, has = e.encode([text, None, "9"])
    s = " " + re.sub(r"[^a-zñ]+", " ", text.lower()) + " "
    want = sum(np.roll(langid.letter_vector(ord(a), 64), 2).astype(int) * np.roll(langid.letter_vector(ord(b), 64), 1) * langid.letter_vector(ord(c), 64) for a, b, c in zip(s, s[1:], s[2:], strict=False))
    assert (v[0] == want).all() and has.tolist() == [True, False, False]


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abç ,9Σσß  ") for _ in range(rng.randint(0, 400))) for _ in range(30)] + [None, "   ", "a"]
    whole = langid.Encoder(32).encode(texts)
    for piece in (3, 7, 50):
        monkeypatch.setattr(langid, "PIECE", piece)
        cut = langid.Encoder(32).encode(texts)
        assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_languages_in_blocks_equal_all_at_once(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["uno", "dos", f"w{i % 37}x", f"q{i % 11}"], k=9)).translate(str.maketrans("0123456789", "abcdefghij")), f"l{i % 37}", "s") for i in range(150)]
    d = docs_of(spark, rows)
    one = langid.identify(d, d.where("doc_id % 3 <> 1"), {"doc_id": F.col("doc_id")}).collect()
    many = langid.identify(d, d.where("doc_id % 3 <> 1"), {"doc_id": F.col("doc_id")}, block=5).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    named = langid.identify(d, d, {"lang_pred": F.col("doc_id"), "score": F.col("text"), "t": F.lit(1)})
    assert named.columns == ["lang_pred_in", "score_in", "t", "lang_pred", "score"] and named.count() == 150


def test_a_cosine_depends_on_its_text_alone():
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    P = langid.units(np.random.default_rng(1).integers(-900, 900, (37, langid.DIMS)), langid.GRID)
    encoder = langid.Encoder()
    every = langid.units(encoder.encode(texts)[0], langid.GRID) @ P.T
    for i, t in enumerate(texts):
        assert (langid.units(encoder.encode([t])[0], langid.GRID) @ P[:5].T == every[i, :5]).all()


def test_op3_equals_brute_force(spark):
    """Prototypes and cosines straight from the definition, for every document of the smallest table."""
    from zlib import crc32

    from netaccess.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    letters, grams = {}, {}

    def vector(text):
        low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        low = f" {' '.join(low.split())} "
        total = np.zeros(langid.DIMS)
        for gram, n in Counter(zip(low, low[1:], low[2:], strict=False)).items():
            if gram not in grams:
                v = [letters.setdefault(c, langid.letter_vector(ord(c)).astype(int)) for c in gram]
                grams[gram] = np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
            total = total + n * grams[gram]
        return total if low.strip() else None

    def whole(v, scale):
        return [round(float(x)) for x in v / max(np.sqrt(float((v * v).sum())), 1e-12) * scale]

    units = {r["doc_id"]: vector(r["text"]) for r in docs}
    learned = {}
    for r in docs:
        if r["lang"] is not None and crc32(str(r["doc_id"]).encode()) % 3 != 1 and units[r["doc_id"]] is not None:
            learned[r["lang"]] = learned.get(r["lang"], 0) + np.array(whole(units[r["doc_id"]], langid.SCALE))
    learned = {k: whole(v.astype(float), langid.GRID) for k, v in learned.items()}
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, u in units.items():
        if u is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        mine = whole(u, langid.GRID)
        dots = {k: sum(a * b for a, b in zip(p, mine, strict=True)) for k, p in learned.items()}
        want = max(sorted(learned), key=dots.get)
        assert (got[i]["lang_pred"], got[i]["score"]) == (want, (1 + dots[want] / langid.GRID**2) / 2)


# --- URLs

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def brute_url(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Com/en/1?x#y", "x://example.com/en/72", "x://notexample.com/en/7", "x://a.example.net/de/88#", "x://b.net/de/", "x://org/es/", "x://É.ORG/es/a\nb", "a://b://c/d", "x://h?q/en/", "x://com", "x://" + "a" * 50_000 + ".org/fr/"]
    urls += [f"http://h{i}.com/en/{i}" for i in range(40)] + [f"http://g{i}.net/de/{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    got = {r["page_id"]: r for r in urlfilter.judge(df, {"page_id": F.col("page_id")}, RULES).collect()}
    kinds = dict(RULES)
    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == brute_url(u), u
        assert got[i]["verdict"] == kinds.get(got[i]["rule"], got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert got[0]["verdict"] == "allow"
    few = spark.createDataFrame([(1, "x://a.fr/q")], "page_id long, url string")
    assert urlfilter.judge(few, {"page_id": F.col("page_id")}, RULES).first()["verdict"] == "allow"


def test_markov_model_sums_to_at_most_one_and_separates():
    good, bad = [f"\x02news.site/{w}\x03" for w in ("alpha", "beta", "gamma", "alpha")], [f"\x02casino.win/{w}\x03" for w in ("spin", "pills", "cash", "spin")]
    m = urlfilter.MarkovModel(good, min_count=1)
    assert sum(m.prob("news.", c) for c in map(chr, range(256))) == pytest.approx(1, abs=0.01)
    assert urlfilter.ratio(m, urlfilter.MarkovModel(bad, min_count=1), "news.site/beta") > 0
    assert urlfilter.calibrated([1.0, 2.0], [-1.0, 0.5]) == 0.75


def brute_ratio(good, bad, url, order=urlfilter.ORDER, least=urlfilter.MIN_COUNT):
    """The score from its definition: counts are looked up in the training texts themselves."""
    def logs(texts, text):
        total = 0.0
        for i in range(1, len(text)):
            p = 1 / 2**16
            for k in range(min(order, i) + 1):
                context, after = text[i - k : i], Counter()
                for t in texts:
                    after.update(t[j] for j in range(max(1, k), len(t)) if t[j - k : j] == context)
                if not after or k and sum(after.values()) < least:
                    break
                p = (after[text[i]] + len(after) * p) / (sum(after.values()) + len(after))
            total += np.log(p)
        return total

    text = urlfilter.normalised(url)
    return (logs(good, text) - logs(bad, text)) / (len(text) - 1)


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(6)
    kinds = {"com/en": ["news", "daily", "paper"], "net/de": ["zeitung", "blatt"], "org/es": ["casino", "bets"]}
    urls = [f"http://{rng.choice(kinds[k])}.{k.split('/')[0]}/{k.split('/')[1]}/{rng.randint(0, 99)}?utm={rng.choice('ab')}" for k in kinds for _ in range(14)]
    urls += [urls[0]] * 40 + [f"http://{rng.choice(sum(kinds.values(), []))}.info/{i}?x=casino" for i in range(6)] + ["noscheme casino", "zeitung"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in urlfilter.judge(df, {"page_id": F.col("page_id")}, RULES).collect()}
    judged = {k: sorted({u for i, u in enumerate(urls) if got[i]["rule"] and got[i]["verdict"] == k}) for k in ("allow", "block")}
    place = {r["url"]: r["h"] for r in df.select("url", F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(2**31)).alias("h")).collect()}
    fitted = {k: [urlfilter.normalised(u) for u in v if place[u] % urlfilter.CALIBRATION] for k, v in judged.items()}
    held = {k: [brute_ratio(fitted["allow"], fitted["block"], u) for u in v if place[u] % urlfilter.CALIBRATION == 0] for k, v in judged.items()}
    cut = urlfilter.calibrated(held["allow"], held["block"])
    opened = [i for i, u in enumerate(urls) if not got[i]["rule"]]
    assert len(opened) >= 8
    for i in opened:
        want = brute_ratio(fitted["allow"], fitted["block"], urls[i]) - cut
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["verdict"] == ("block" if want < 0 else "allow")


# --- mixing


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.water_fill([10, 1000], [5, 2]) == [30.0, 980.0]
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 5], [5, 2]) == [0.0, 5.0]


def test_mix_meets_targets_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 50)), None, rng.choice(["a", "b", "é", None, "z"])) for i in range(20, 320)]
    d = docs_of(spark, [*rows, *ODD])
    got = mixing.mix(d, ["doc_id", "source"]).collect()
    assert len(got) == d.count()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0]["source_size"]
        assert sum(r["taken"] for r in rs) == int(rs[0]["target"])
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(sum(r["size"] for r in got))
    again = mixing.mix(d.repartition(7), ["doc_id", "source"]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    made = mixing.sample(d)
    assert made.columns == d.columns
    words = made.select(mixing.n_words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == sum(r["taken"] for r in got)
    assert mixing.mix(d.limit(0), ["doc_id"]).count() == 0


def test_mix_with_a_source_of_one_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 3)
    rows = [(7, "one two three", "en", None)] * 700 + [(i, f"word{i} and more", "en", "a") for i in range(300)] + [(7, "one two three", "fr", None)] * 50
    d = docs_of(spark, rows).repartition(5)
    got = mixing.mix(d, ["doc_id", "lang", "source"]).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 9 for r in got)
    for s in (None, "a"):
        mine = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"])
    # only one row is taken in part, and which equal row it is cannot be seen
    assert sum(r["taken"] % 3 > 0 for r in got if r["source"] is None) <= 1
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(d.repartition(3), ["doc_id", "lang", "source"]).collect()))
    words = mixing.sample(d).select(mixing.n_words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == sum(r["taken"] for r in got)


@pytest.mark.parametrize("text,n", [("", 1), (" a  b\tc ", 2), ("one", 1), ("a b", 5), ("  x", 0), ("é ñ ü", 2), ("a\n\nb  c", 2)])
def test_words_upto(spark, text, n):
    got = spark.createDataFrame([(text, n)], "t string, n long").select(mixing.words_upto(F.col("t"), F.col("n")).alias("x")).first()[0]
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert re.findall(r"[^\x20\x09-\x0D]+", got) == words[: max(0, n)] and (n <= 0 or text.startswith(got))


CLASH = ["x", "size", "taken", "source_size", "target", "p_size", "a.b", "row", "shard", "slot", "old_shard", "c0", "o", "id", "h", "block", "component_id", "kept", "score", "__size"]


def test_clashing_names_and_odd_rows_everywhere(spark):
    """Columns of any name are carried as they are; null and repeated ids, null and empty texts crash nothing."""
    rng = random.Random(14)
    rows = [(i, prose(rng, 70), "en", rng.choice("ab")) for i in range(30)] + [*ODD, ODD[3], (None, None, None, None), (None, None, None, None)]
    d = docs_of(spark, rows)
    for i, c in enumerate(CLASH):
        d = d.withColumn(c, F.lit(7 + i))
    b = spark.createDataFrame([(0, prose(rng, 20)), (1, "no such words here at all"), (2, "no id here")], "item_id long, text string")
    stages = {
        "quality": quality.filter_good(d), "near-dedup": neardup.deduplicate(d), "decontaminate": decontaminate.decontaminate(d, b), "mix": mixing.sample(d),
    }
    for name, out in stages.items():
        assert out.columns == d.columns, name
        for r in out.collect():
            assert [r[c] for c in CLASH] == [7 + i for i in range(len(CLASH))], name
    mixed = mixing.mix(d, ["doc_id", "x", "a.b", "taken"])
    assert mixed.columns == ["doc_id", "x", "a.b", "taken_in", "size", "source_size", "target", "taken"]
    assert {(r["x"], r["a.b"], r["taken_in"]) for r in mixed.collect()} == {(7, 13, 9)}
    moved = sharding.reshard(d, d.columns, old_shards=3)
    assert moved.count() == d.count() and moved.columns[-4:] == ["size", "old_shard", "shard", "slot"] and len(set(moved.columns)) == len(moved.columns)
    import corpus_pipeline

    last = corpus_pipeline.shard(spark, d, "")
    assert last.count() == d.count()
    left = [r["text"] for r in stages["decontaminate"].collect()]
    assert "no id here" not in left  # an item of three words, in a row without an id


# --- near-duplicates


def brute_components(texts, threshold):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def near_copies(rng, n, words=120):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    texts = near_copies(rng, 60) + near_copies(rng, 9) + [prose(rng, 80) for _ in range(30)] + ["Short text", "short  TEXT", "", None, "one"]
    texts += ["é É " * 10, "é É " * 10]
    rows = dict(enumerate(texts))
    d = docs_of(spark, [(k, t, None, None) for k, t in rows.items()])
    for threshold in (85, 80):
        got = {r["doc_id"]: r for r in neardup.near_duplicates(d, threshold=threshold).collect()}
        want = brute_components(rows, threshold)
        assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
        assert all(r["kept"] == (k == want[k][1]) for k, r in got.items())
    kept = neardup.deduplicate(d, threshold=85)
    assert kept.columns[0] == "doc_id" and kept.count() == len({c for _, c in brute_components(rows, 85).values()})


def test_near_duplicates_odd_rows(spark):
    d = docs_of(spark, ODD)
    got = neardup.near_duplicates(d).collect()
    assert len(got) == len(ODD)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert neardup.near_duplicates(d.limit(0)).count() == 0


def test_forest_joins_what_links_join():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(30), 20)), dtype=np.int64) for _ in range(40)]
    comp = list(range(40))
    found = neardup.forest(sets, comp, [0] * 40, 70)

    def parts(edges):
        root = list(range(40))
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return [find(i) for i in range(40)]

    every = [(i, j) for i in range(40) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 70 * len(set(sets[i]) | set(sets[j]))]
    assert parts(found) == parts(every) and len(found) < 40


# --- quality


def test_quality_on_planted_faults(spark):
    rng = random.Random(4)
    good = [(i, prose(rng, 80), "en", "s") for i in range(120)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "en", "s") for i in range(15)]
    bad += [(1100 + i, " ".join(w + rng.choice(["%%%", "###"]) for w in prose(rng, 60).split()), "en", "s") for i in range(15)]
    d = docs_of(spark, [*good, *bad, *[(2000 + (r[0] or 0), *r[1:]) for r in ODD]]).withColumn("score", F.lit("clash")).withColumn("kept", F.lit(0))
    got = {r["doc_id"]: r for r in quality.classify(d, {"doc_id": F.col("doc_id")}).collect()}
    assert all(got[r[0]]["kept"] for r in good) and not any(got[r[0]]["kept"] for r in bad)
    assert got[2001]["score"] == 0 and not got[2002]["kept"]
    named = quality.classify(d, {"score": F.col("doc_id"), "Kept": F.col("text"), "t": F.lit(1)})
    assert named.columns == ["score_in", "Kept_in", "t", "score", "posterior", "kept"] and named.count() == d.count()
    kept = quality.filter_good(d)
    assert kept.columns == d.columns and {r[0] for r in good} <= {r["doc_id"] for r in kept.collect()}
    assert quality.filter_good(d.limit(0)).count() == 0


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(0)
    counts = Counter()
    k = quality.LABELLERS
    truth = []
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = [(2 if rng.random() < 0.95 else 0) if good else (1 if rng.random() < 0.6 else 2 if rng.random() < 0.5 else 0) for _ in range(k)]
        code = 0
        for v in votes:
            code = code * 3 + v
        counts[code] += 1
        truth.append((code, good))
    post, prior, _ = quality.expectation_maximisation(counts)
    assert abs(prior - 0.8) < 0.03
    assert sum((post[c] > 0.5) == g for c, g in truth) / len(truth) > 0.98


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_accuracies_of_overlapping_labellers_are_recovered(seed):
    """Documents are bad in one of four ways, each seen by labellers that overlap; good ones are objected to by chance."""
    rng = np.random.default_rng(seed)
    k = quality.LABELLERS
    ways = np.full((5, k, 3), 0.0)
    ways[0] = [0.095, 0.005, 0.9]  # good: no vote, bad, good
    for way, seers in enumerate([(0, 1), (2, 3, 4), (5, 6), (7, 8, 0)], 1):
        ways[way] = [0.3, 0.01, 0.69]
        for s in seers:
            ways[way, s] = [0.1, 0.8, 0.1]
    share = np.array([0.8, 0.05, 0.05, 0.05, 0.05])
    n = 40_000
    kind = rng.choice(5, n, p=share)
    votes = (rng.random((n, k, 1)) > np.cumsum(ways[kind], axis=2)).sum(2)
    codes = votes @ (3 ** np.arange(k - 1, -1, -1))
    post, prior, table = quality.expectation_maximisation(Counter(codes.tolist()))
    good = ways[0]
    bad = (share[1:, None, None] * ways[1:]).sum(0) / share[1:].sum()
    assert abs(prior - 0.8) < 0.05
    assert np.abs(table[:, 1] - good).max() < 0.05 and np.abs(table[:, 0] - bad).max() < 0.05
    # an objection is not a verdict: some are outvoted
    assert 0 < table[:, 1, 1].min() < table[:, 1, 1].max()


@pytest.mark.parametrize("false", [0.005, 0.05, 0.1, 0.2])
@pytest.mark.parametrize("good", [0.5, 0.7, 0.9])
def test_false_objections_are_estimated(false, good):
    """Independent labellers: the estimates come from the votes at every rate, one labeller may be worse than the others."""
    rng = np.random.default_rng(5)
    n, k = 20_000, quality.LABELLERS
    fine = rng.random(n) < good
    rate = np.full(k, false)
    rate[3] = 0.2
    bad = np.where(fine[:, None], rng.random((n, k)) < rate, rng.random((n, k)) < 0.6)
    codes = (np.where(bad, 1, 2) * 3 ** np.arange(k - 1, -1, -1)).sum(1)
    post, share, table = quality.expectation_maximisation(Counter(codes.tolist()))
    assert abs(share - good) < 0.05
    assert np.abs(table[:, 1, 1] - rate).max() < 0.05 and np.abs(table[:, 0, 1] - 0.6).max() < 0.05
    assert ((np.array([post[c] for c in codes.tolist()]) > 0.5) == fine).mean() > 0.9


def brute_votes(text):
    """The labellers as their descriptions say, word by word."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    if not n:
        return None
    def shouted(w):
        return sum(c.isalpha() for c in w) >= 2 and w.upper() == w and w.lower() != w

    def ends_doubled(w):
        return len(w) >= 2 and not w[-1].isalnum() and w[-2] == w[-1]

    share = lambda f: sum(map(f, words)) / n
    values = {
        "noise": share(ends_doubled), "capitals": share(shouted), "bars": share(lambda w: not any(map(str.isalnum, w))),
        "echo": sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n - 1),
        "repeated": max(0.0, 1 - len(set(words)) / min(n, 12 * n**0.6)) if n >= 10 else 0.0,
        "lines": 1 - len(set(lines)) / max(1, len(lines)), "long": share(lambda w: len(w) > 30), "digits": share(lambda w: any(map(str.isdigit, w))),
        "marks": share(lambda w: not w[-1].isalnum() and w[-1] not in quality.PUNCTUATION),
    }
    votes = [1 if values[k] >= bad else 2 if values[k] <= good else 0 for k, bad, good in quality.SHARES]
    return [*votes, 0 if n < 15 else 2 if 0.02 <= share(lambda w: w[-1] in ".?!;:") <= 0.35 else 1]


def test_op1_equals_brute_force_and_labels(spark):
    from netaccess.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    votes = {i: brute_votes(t) for i, t in docs.items()}
    code = lambda v: sum(x * 3 ** (len(v) - 1 - i) for i, x in enumerate(v))
    post, _, _ = quality.expectation_maximisation(Counter(code(v) for v in votes.values() if v))
    got = {r["doc_id"]: r for r in queries.op1_quality(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, v in votes.items():
        assert got[i]["posterior"] == pytest.approx(post[code(v)] if v else 0.0, abs=1e-9)
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    right = [got[r["doc_id"]]["kept"] == (r["quality"] == 1) for r in labels]
    assert sum(right) / len(right) > 0.98


def test_long_words_count_whole():
    assert quality.shape("a" * 200 + "1!!") == "a0!!" and quality.shape("x1" * 300) == "a0" * 300


# --- secrets


def brute_spans(text):
    """The contract's patterns as written."""
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        out += [(m.start(), m.end(), "assign")] * (len(m[2]) >= 12)
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 16]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


TRICKY = ["secret: token: abcdefghijklmnop", "PassWord==" + "x" * 12, "api_key = 'short'", "AKIAAKIA" + "B" * 10, "ſecret=" + "a" * 20, "é token=\"" + "f" * 16 + "\" AKIA" + "Z9" * 8, "token = 0123456789abcdef0", ""]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert secrets.base_spans(text) == brute_spans(text)


def test_viterbi_and_pruned_decoding_equal_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        T = rng.normal(size=(3, 3))
        T[0, 2] = -1e6
        E = rng.normal(size=(n, 3)) * 3

        def value(tags, E=E, T=T):
            path = [0, *tags, 0]
            return sum(T[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(E[i, t] for i, t in enumerate(tags))

        best = max(np.ndindex(*[3] * n), key=value)
        assert tuple(secrets.viterbi(E, T)) == best
    E = rng.normal(size=(200, 3)) + np.where(rng.random((200, 1)) < 0.7, [[30, 0, 0]], 0)
    assert secrets.decode(E, T).tolist() == secrets.viterbi(E, T)


def test_scan(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"{prose(rng, 20)} token = \"{key()}\" {prose(rng, 20)}", None, None) for i in range(40)] + [(100 + i, t, None, None) for i, t in enumerate(TRICKY)]
    d = docs_of(spark, [*rows, *[(500 + (r[0] or 0), *r[1:]) for r in ODD]]).withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r for r in secrets.scan(d, {"doc_id": F.col("doc_id")}).collect()}
    for i, t, _, _ in rows:
        base = brute_spans(t)
        assert got[i]["base"] == secrets.digest(base)
        assert set(got[i]["base"].split(",")) - {""} <= set(got[i]["spans"].split(","))
        assert got[i]["n_hex"] == sum(k == "hex" for *_, k in base)
    assert got[501]["spans"] == "" and secrets.scan(d.limit(0), {"doc_id": F.col("doc_id")}).count() == 0
    W, T = secrets.fit(d)
    lexicon = secrets.Lexicon(W)
    text = prose(rng, 20) + f' token = "{key()}" ' + prose(rng, 20)
    tagged = secrets.crf_spans(text, [], lexicon, T, W[secrets.document_feature(text)])
    assert any(s <= text.index('"') + 1 and e >= text.index('"') + 40 for s, e, _ in tagged)
    assert lexicon._cached("There").tolist() == lexicon._row("There").tolist()


def test_stretches_come_from_anywhere():
    rng = random.Random(7)
    text = prose(rng, 9000) + " " + " ".join(f'token = "{i:040x}" {prose(rng, 40)}' for i in range(1, 60))
    assert len(text) > 20_000
    seen = [t for _, t in secrets.sequences_of(text)]
    assert sum(t.count(secrets.BEGIN) for t in seen) == 2 * 59  # each span, and once more masked


def test_kinds_that_were_held_out_are_found(spark):
    rng = random.Random(3)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    abc = "abcdefghijklmnopqrstuvwxyz"
    make = [lambda: f'{rng.choice(["password", "token", "api_key"])} = "{pick(abc + abc.upper() + "0123456789", rng.randint(16, 32))}"', lambda: "AKIA" + pick(abc.upper() + "0123456789", 16), lambda: pick("0123456789abcdef", rng.choice([32, 40]))]
    rows = [(i, f"{prose(rng, 30)} {make[i % 4]() if i % 4 < 3 else ''} 2019 a@b.org 192.168.1.12 {prose(rng, 30)}", None, None) for i in range(300)]
    d = docs_of(spark, rows)
    for kind, least in (("access", 0.9), ("hex", 0.9)):
        found, every = secrets.held_out_recall(d, kind)
        assert every == 75 and found >= least * every
    spans = secrets.scan(d.where("doc_id % 4 = 3"), {"doc_id": F.col("doc_id")}).collect()
    assert all(r["spans"] == "" for r in spans)  # clean documents are left alone


# --- sharding


def test_min_cost_flow_moves_least():
    rng = random.Random(6)
    for _ in range(30):
        supply = [rng.randint(0, 9) for _ in range(3)]
        total = sum(supply)
        capacity = [total // 3 + (j < total % 3) for j in range(3)]
        flow = sharding.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(3)] == supply
        assert sum(f for (i, j), f in flow.items() if i != j) == sum(max(0, s - c) for s, c in zip(supply, capacity, strict=True))
    costs = {(i, j): rng.randint(0, 9) for i in range(3) for j in range(3)}
    flow = sharding.min_cost_flow([1, 1, 1], [1, 1, 1], lambda i, j: costs[i, j])
    assert sum(costs[k] * f for k, f in flow.items()) == min(sum(costs[i, p[i]] for i in range(3)) for p in permutations(range(3)))


def test_reshard(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "copy" if i % 3 == 0 else prose(rng, rng.randint(1, 60)), None, None) for i in range(20, 2000)]
    d = docs_of(spark, [*rows, *ODD[:6]])
    got = sharding.reshard(d, ["doc_id", "text"], blocks=256).collect()
    assert len(got) == d.count()
    by, group = {}, {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
        group.setdefault(r["text"] or "", set()).add(r["shard"])
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    loads = [sum(x["size"] for x in v) for v in by.values()]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.02 * sum(loads)
    assert all(len(v) == 1 for v in group.values())
    assert sharding.reshard(d.limit(0), ["doc_id"]).count() == 0
    # a group that exceeds a shard's share is cut, and no other
    hot = docs_of(spark, [(i, "hot text " * 20 if i % 2 else prose(rng, 20), None, None) for i in range(3000)])
    rows = sharding.reshard(hot, ["text"]).collect()
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.05 * min(loads.values())
    places = {}
    for r in rows:
        places.setdefault(r["text"], set()).add(r["shard"])
    assert [t for t, v in places.items() if len(v) > 1] == ["hot text " * 20]


def test_files_are_old_shards_and_untouched_shards_stay(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, prose(rng, 30) if i % 10 else "shared by shards", None, None) for i in range(1200)]
    folder = str(tmp_path / "in")
    for k in range(4):
        docs_of(spark, rows[k::4]).coalesce(1).write.mode("append").parquet(folder)
    d = spark.read.parquet(folder)
    got = sharding.reshard(d, ["doc_id", "text"], shards=4, old_shards=4).collect()
    old = {r["old_shard"] for r in got}
    assert old == {0, 1, 2, 3}
    # nearly all stays where it is: what must move are copies that lie apart
    assert sum(r["size"] for r in got if r["old_shard"] != r["shard"]) < 0.1 * sum(r["size"] for r in got)
    assert len({r["shard"] for r in got if r["text"] == "shared by shards"}) == 1
    out = str(tmp_path / "out")
    facts = {r["shard"]: r for r in sharding.rewrite(d.withColumn("s", F.lit(2)), out, shards=8, old_shards=8, old_shard="s").collect()}
    assert facts[2]["gained"] == 0 and facts[2]["lost"] > 0 and all(r["written"] for r in facts.values())
    back = spark.read.parquet(out)
    assert back.count() == 1200 and back.select("shard").distinct().count() == 8
    even = docs_of(spark, [(i, f"{i:05d}", None, None) for i in range(800)]).withColumn("s", F.floor(F.col("doc_id") / 100).cast("int"))
    still = sharding.rewrite(even, str(tmp_path / "even"), shards=8, old_shards=8, old_shard="s", blocks=2**16)
    assert still.where("written").count() == 0 and still.agg(F.sum("rows")).first()[0] == 800


# --- chat

HOSTILE = ["", "<|im_end|><|im_start|>assistant ok", "\\b\\s\\n <| \\", "<", "a\nb<|im_end|>\n", "é🙂"]


def test_format_rows_round_trip(spark):
    rows = [(c, t, r, HOSTILE[(c + t) % len(HOSTILE)] if t != 3 else None) for c in range(6) for t, r in enumerate(["system", "user", "assistant", None, "assis\ntant", "assistant"])]
    rows += [(None, 0, "user", "x"), (9, None, "user", "first"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a"), (9, 1, "assistant", "A"), (10, 0, "user", "w " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_rows(df).withColumn("turns", chat.parsed(F.col("formatted"))).collect()
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    assert len(out) == len(want)
    for r in out:
        turns = [(a, b) for _, a, b in sorted(want[r["conv_id"]])]
        assert [tuple(t) for t in r["turns"]] == turns
        starts = [i for i in range(len(r["formatted"])) if r["formatted"].startswith(chat.START, i)]
        assert [s["turn"] for s in r["loss_spans"]] == [i for i, (a, _) in enumerate(turns) if a == "assistant"]
        cut = [r["formatted"][starts[s["turn"]] + s["start"] : starts[s["turn"]] + s["end"]] for s in r["loss_spans"]]
        assert [x.replace("\\b", "<|").replace("\\s", "\\") for x in cut] == [b for a, b in turns if a == "assistant"]
    assert chat.format_rows(df.limit(0)).count() == 0


def test_layouts_by_fingerprint(spark):
    js = ['{"prompt": "p", "response": "r"}', '{"output": "o", "instruction": "i", "input": "n"}', '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "<|"}], "id": 3}', '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', "not json", None, "{}", '{"instruction": "i", "output": "o"}']
    df = spark.createDataFrame([(i, j) for i, j in enumerate(js)], "id int, j string")
    got = {r["id"]: r["t"] and [tuple(x) for x in r["t"]] for r in df.select("id", chat.canonical(df, "j").alias("t")).collect()}
    assert got == {0: [("user", "p"), ("assistant", "r")], 1: [("user", "i\nn"), ("assistant", "o")], 2: [("user", "hi"), ("assistant", "<|")], 3: [("user", "h"), ("assistant", "g")], 4: None, 5: None, 6: None, 7: [("user", "i"), ("assistant", "o")]}
    typed = spark.createDataFrame([("a", "b", 1)], "question string, answer string, extra int")
    assert [tuple(x) for x in typed.select(chat.canonical(typed).alias("t")).first()["t"]] == [("user", "a"), ("assistant", "b")]
    plan = df.select(chat.formatted(chat.canonical(df, "j")).alias("f"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_conversations_reach_turns_by_fingerprint_only(spark, monkeypatch):
    from netaccess.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    own = spark.createDataFrame([(900, 0, "tool", "x"), (900, 1, "assistant", None), (901, 0, "System", "y"), (902, 0, "user", "u"), (902, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    mixed = chat.in_layouts(chat.gathered(rows.select("conv_id", "turn", "role", "text").unionByName(own.select("conv_id", "turn", "role", "text"))))
    seen = mixed.select("conv_id", chat.layout(mixed).alias("f"), chat.canonical(mixed).alias("c"), F.col("turns").isNotNull().alias("own")).collect()
    assert len({r["f"] for r in seen}) >= 4 and {r["conv_id"] for r in seen if r["own"]} >= {900, 901}
    assert all(r["c"] is not None for r in seen)
    assert [tuple(t) for t in next(r["c"] for r in seen if r["conv_id"] == 901)] == [("System", "y")]
    plan = queries.op9_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    # without the mappings no conversation is formatted: the query has no other way
    monkeypatch.setattr(chat, "MAPPINGS", {})
    assert {r["n_turns"] for r in queries.op9_chat_format(spark, sf).collect()} <= {None, -1}


def test_op9_keeps_every_role(spark, tmp_path):
    import duckdb

    from netaccess.llm import queries

    roles = ["human", "bot", "GPT", "gpt", "model", "system", "user", "assistant", "Human", None]
    rows = [(c, t, roles[(c + t * (1 + c % 3)) % len(roles)], f"text {c} {t}") for c in range(40) for t in range(1 + c % 6)]
    rows += [(c, t, r, "x") for c in (50, 51) for t, r in enumerate(["system", "bot", "user", "assistant"][c - 50 :])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op9_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    wanted = con.sql(queries.ORACLE_SQL["op9_chat_format"])
    columns = sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(wanted.select(*columns).fetchall())


# --- decontamination


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(50):
        a, b = [rng.randint(1, 6) for _ in range(rng.randint(0, 12))], [rng.randint(1, 6) for _ in range(rng.randint(0, 12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y and x > 1 else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]


def test_decontaminate_planted_and_edited(spark):
    rng = random.Random(10)
    item = lambda n: " ".join(f"q{rng.randint(0, 3000)}" for _ in range(n))
    bench = [(i, item(rng.randint(15, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "two wordsthatnonehas")]
    rows = []
    for i in range(120):
        text = prose(rng, 150).split()
        if i % 4 == 0:
            words = bench[i % 30][1].split()
            if i % 8 == 0:  # an edited copy: one word in eight replaced
                words = [w if k % 8 else "changed" for k, w in enumerate(words)]
            text[40:40] = words
        rows.append((i, " ".join(text), None, None))
    d = docs_of(spark, [*rows, *[(500 + (r[0] or 0), *r[1:]) for r in ODD]])
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(i, i % 30) for i in range(0, 120, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b, block=10).collect()} == got
    assert decontaminate.decontaminate(d, b).count() == d.count() - 30
    assert decontaminate.contaminated(d, b.limit(0)).count() == decontaminate.contaminated(d.limit(0), b).count() == 0


@pytest.mark.parametrize("n", [400, 4000])
def test_decontaminate_short_edited_and_long_items(spark, n):
    rng = np.random.default_rng(n)
    word = lambda k: [f"v{int(x)}" for x in np.minimum(rng.zipf(1.3, k), 10**7)]
    items = [word(6) for _ in range(40)] + [word(30) for _ in range(40)] + [word(350) for _ in range(40)]
    rows, want = [], set()
    for i in range(n):
        text = [w + "x" for w in word(90)]  # words that no item has: nothing is found by chance
        if i < 240:
            copy = list(items[i % 120])
            if i >= 120 and len(copy) > 6:  # an edited copy: words replaced, left out and put in
                copy = [w if k % 8 else "changed" for k, w in enumerate(copy) if k % 16 != 5]
                copy = [x for k, w in enumerate(copy) for x in ([w, "put", "in"] if k % 9 == 4 else [w])]
            text[37:37] = copy
            want.add((i, i % 120))
        rows.append((i, " ".join(text), None, None))
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, rows), b).collect()}
    assert want <= got
    assert {d for d, _ in got} == {d for d, _ in want}


def test_blocks_are_bounded_by_passages(spark, monkeypatch):
    rng, seen = random.Random(4), []
    items = [(i, " ".join(f"w{rng.randint(0, 20_000)}" for _ in range(300))) for i in range(120)]
    axes = decontaminate.latent_axes
    monkeypatch.setattr(decontaminate, "latent_axes", lambda s, passages, idf: seen.append(len(passages)) or axes(s, passages, idf, axes=8))
    monkeypatch.setattr(decontaminate, "AT_ONCE", 2)
    d, b = docs_of(spark, [(i, t, None, None) for i, t in items[:30]]), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(i, i) for i in range(30)}  # found although 8 axes hold next to nothing
    assert sum(seen) == 120 * 47 and len(seen) > 1 and max(seen) <= 1.5 * decontaminate.PASSAGES


def test_many_items_are_searched_in_one_reading(spark):
    rng = random.Random(15)
    items = [(i, " ".join(f"w{rng.randint(0, 9000)}" for _ in range(25))) for i in range(1000)]
    d = docs_of(spark, [(i, prose(rng, 40) + " " + items[i * 7][1], None, None) for i in range(140)])
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(d, b)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i * 7) for i in range(140)}
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    few = decontaminate.contaminated(d, b, at_once=2)
    assert {(r["doc_id"], r["item_id"]) for r in few.collect()} == {(i, i * 7) for i in range(140)}


def test_short_items_are_whole_sequences(spark):
    texts = ["say deep blue sea now", "deep, blue - Sea!", "blue deep sea", "sea", "the deep blue", None, ""]
    b = spark.createDataFrame([(1, "Deep blue sea."), (2, "sea"), (3, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)]), b).collect()}
    assert got == {(0, 1), (1, 1), (0, 2), (1, 2), (2, 2), (3, 2)}


def test_op10_equals_an_exhaustive_search(spark):
    """Every window of every document against every item by common subsequences: none is missed, none is added."""
    from netaccess.llm import queries

    sf = "/root/testdata/sf0.001"
    items = [(r["item_id"], decontaminate.item_words(r["text"]), decontaminate.answer_length(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    number = {w: i + 2 for i, w in enumerate(sorted({w for _, ws, _ in items for w in ws}))}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        x = [number.get(w, 1) for w in decontaminate.item_words(r["text"])]
        for i, ws, a in items:
            ws = [number[w] for w in ws]
            span = len(ws) * 3 // 2
            for s in range(0, max(1, len(x) - span + 1 + len(ws) // 4), max(1, len(ws) // 6)):
                near = x[s : s + span]
                share = decontaminate.common_subsequence(ws, near) / len(ws)
                if share >= decontaminate.ALONE or share >= decontaminate.WITH_ANSWER and decontaminate.common_subsequence(ws[-a:], near) / a >= decontaminate.ANSWER:
                    want.add((r["doc_id"], i))
                    break
    rows = queries.op10_decontaminate(spark, sf).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in rows} == want


def test_latent_search_by_itself(spark):
    """It finds nine of ten of all pairs without the windows' help, and stretched copies that no window holds."""
    from netaccess.llm import queries

    rows = queries.op10_decontaminate(spark, "/root/testdata/sf0.01").collect()
    long = [r for r in rows if r["found_by"] != "sequence"]
    assert long and sum("latent" in r["found_by"] for r in long) >= 0.9 * len(long)
    rng = random.Random(21)
    words = [f"w{i}" for i in range(6000)]
    items = [(i, " ".join(rng.choices(words, k=36))) for i in range(60)]
    stretched = lambda t: " ".join(f"{w} {rng.choice(['and', 'the', 'so'])} |" for w in t.split())
    d = docs_of(spark, [(i, " ".join([prose(rng, 60), stretched(items[i][1]), prose(rng, 60)]), None, None) for i in range(20)] + [(100 + i, prose(rng, 200), None, None) for i in range(80)])
    got = {(r["doc_id"], r["item_id"]): r["found_by"] for r in decontaminate.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(i, i) for i in range(20)} and set(got.values()) == {"latent"}


def test_decontaminate_judges_rows_not_ids(spark):
    rng = random.Random(12)
    item = " ".join(f"q{rng.randint(0, 3000)}" for _ in range(30))
    bad, good = prose(rng, 60) + " " + item, prose(rng, 60)
    d = docs_of(spark, [(None, bad, None, None), (None, good, None, None), (1, bad, None, None), (1, good, None, None), (2, None, None, None)])
    b = spark.createDataFrame([(0, item), (1, "some other words of a second block")], "item_id long, text string")
    for block in (1, 200):
        left = decontaminate.decontaminate(d, b, block=block)
        assert left.columns == d.columns
        assert sorted(left.select("doc_id", "text").collect(), key=str) == sorted([(None, good), (1, good), (2, None)], key=str)


def test_deduplicate_leaves_one_row_of_each_component(spark):
    rng = random.Random(13)
    long = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(120))
    a, b, c, e = long(), long(), long(), long()
    near = a + " end"
    rows = [(1, a), (1, a), (2, near), (None, a), (None, b), (None, b), (3, c), (5, near), (5, e), (6, None), (6, None), (7, " ")]
    d = docs_of(spark, [(i, t, None, None) for i, t in rows])
    left = neardup.deduplicate(d, threshold=80)
    assert left.columns == d.columns
    want = [(1, a), (None, b), (3, c), (5, e), (6, None), (6, None), (7, " ")]
    assert sorted(left.select("doc_id", "text").collect(), key=str) == sorted(want, key=str)


# --- pipeline and queries


def test_pipeline_equals_brute_force(spark):
    """Every decision of the five stages against plain Python on the smallest table."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        outs.append(docs.collect())
    good, unique, clean, mixed, sharded = outs
    verdict = {r["doc_id"]: r["kept"] for r in quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), {"doc_id": F.col("doc_id")}).collect()}
    assert {r["doc_id"] for r in good} == {i for i, k in verdict.items() if k}
    parts = brute_components({r["doc_id"]: r["text"] for r in good}, 80)
    assert {r["doc_id"] for r in unique} == {c for _, c in parts.values()}
    held = {r["doc_id"] for r in decontaminate.contaminated(spark.createDataFrame(unique), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in unique} - held
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in clean:
        sizes[r["source"]] = sizes.get(r["source"], 0) + count(r["text"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.water_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken, whole = Counter(), {r["doc_id"]: r["text"] for r in clean}
    for r in mixed:
        taken[r["source"]] += count(r["text"])
        assert whole[r["doc_id"]].startswith(r["text"])
    assert all(taken[s] == int(t) for s, t in target.items())
    assert Counter((r["doc_id"], r["text"]) for r in sharded) == Counter((r["doc_id"], r["text"]) for r in mixed)
    loads, groups = Counter(), {}
    for r in sharded:
        loads[r["shard"]] += r["size"]
        groups.setdefault(r["text"], set()).add(r["shard"])
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in sharded)
    fair = sum(loads.values()) / 8
    assert all(len(v) == 1 for t, v in groups.items() if sum(r["size"] for r in sharded if r["text"] == t) <= fair)
    slots = {}
    for r in sharded:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_pipeline_decisions(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = out.cache()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        assert not any(r["text"] in t for t in texts.values())
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert last.count() == docs.count() and last.select("shard").distinct().count() == 8


def test_contract_columns(spark):
    from netaccess.llm import queries

    sf = "/root/testdata/sf0.001"
    want = {
        "op3_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op5_mix": {"doc_id", "size", "source_size", "target", "taken"},
        "op7_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, "op8_reshard": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    }
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, sf)
        assert columns <= set(got.columns)
        rows = got.collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
        if name == "op7_secrets":
            assert all(r["base_sha256"] == hashlib.sha256(secrets.digest(brute_spans(docs[r["doc_id"]])).encode()).hexdigest() for r in rows)


def test_vocabulary_holds_no_more_than_the_benchmark():
    v = decontaminate.Vocabulary(["don't", "été", "x1"])
    text = "«Été», don't -- x1! X1 'don't' x-1 ²x1 " + " ".join(f"w{i}," for i in range(500))
    assert v.numbers(text)[:9].tolist() == [3, 2, 0, 4, 4, 2, 1, 1, 1] and sorted(v.held(text)) == [2, 3, 4]
    assert len(v.numbers(None)) == 0 and v.held("-- ?") == []
    assert set(v.base) == {"don't", "été", "x1", ""}


def test_links_are_joined_in_their_tasks_and_no_links_run_no_plan(spark):
    scratch = neardup.Scratch(spark)
    ends = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (7, 7)]
    random.Random(5).shuffle(ends)
    nodes = sorted({x for e in ends for x in e} | {5000})
    labels = scratch.keep(spark.createDataFrame([(x, x) for x in nodes], "node long, comp long"))
    none = scratch.keep(spark.createDataFrame([], "u long, v long"))
    before = scratch.n
    assert neardup.merged(labels, none, scratch) is labels and scratch.n == before
    links = scratch.keep(spark.createDataFrame(ends, "u long, v long").coalesce(1))
    before = scratch.n
    got = {r["node"]: r["comp"] for r in neardup.merged(labels, links, scratch).collect()}
    assert got == {x: 0 if x <= 300 else 1000 if x <= 1001 else x for x in nodes}
    assert scratch.n - before <= 5  # 12 without joining them first
    scratch.close()
    one = pd.concat(list(neardup.stars(iter([pd.DataFrame({"u": [3, 9, 4], "v": [9, 4, 1]}), pd.DataFrame({"u": [8], "v": [8]})]))))
    assert sorted(map(tuple, one.values.tolist())) == [(3, 1), (4, 1), (8, 8), (9, 1)]
