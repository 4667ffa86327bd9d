"""Operators that compare rows, and the pipeline: against brute force on small tables, and on the hard rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkwarden.llm import bpe, decontam, near_dedup, pii, queries, topk, url_rules
from sparkwarden.llm.blocks import maybe_among
from sparkwarden.session import ensure_checkpoint_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- near duplicates -----------------------------------------------------------------------------------------------


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    """id -> smallest id reachable, over all pairs, at the contract's threshold."""
    sets = [(i, plain_set(t)) for i, t in rows if i is not None]
    low = {i: i for i, _ in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    return {i: root(i) for i in low}


def varied(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def near_rows():
    """Chains, a large group of near copies at all distances, exact copies, short texts, and the hard rows."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 6)))
    texts = []
    for size in (3, 5, 7, 12, 40, 150, 400):
        base = [word() for _ in range(size)]
        for edits in range(6):
            texts += [" ".join(varied(rng, base, edits)) for _ in range(4)]
        chain = base
        for _ in range(6):
            chain = varied(rng, chain, max(1, size // 80))
            texts.append(" ".join(chain))
    base = [word() for _ in range(120)]
    texts += [" ".join(varied(rng, base, rng.randint(0, 6))) for _ in range(150)]
    texts += ["Same  WORDS\there"] * 20 + ["same words here", "same words", None, "", " \n ", "x", "X"]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return [*rows, (rows[5][0], rows[5][1]), (rows[6][0], "another text under a known id, long enough to have shingles"), (None, rows[7][1]), (None, None)]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    table = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, key string, id long, hub long, n long")
    out = near_dedup.near_duplicates(table).collect()
    assert len(out) == len(rows)
    expected = plain_components(rows)
    sizes = {}
    for i, t in rows:
        sizes.setdefault(i, set()).add(len(plain_set(t)))
    for row in out:
        assert row["n_shingles"] in sizes[row["doc_id"]]
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert row["component_id"] == expected[row["doc_id"]], row
            assert row["kept"] == (row["doc_id"] == row["component_id"])


def plain_components_at(rows, least):
    """Like ``plain_components``, at any threshold; no null ids."""
    sets, low = [(i, plain_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= least * len(x | y):
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    return {i: root(i) for i in low}


@pytest.mark.parametrize("least", [80, 85])
def test_near_duplicates_at_a_threshold_equal_brute_force(spark, least):
    rows = [(i, t) for i, t in near_rows() if i is not None]
    expected = plain_components_at(rows, least)
    assert plain_components_at(rows, 80) != plain_components_at(rows, 85)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table, least=least).collect()} == expected


def counted(monkeypatch, name):
    """Rows that every call of a step of near_dedup gives from now on."""
    step, seen = getattr(near_dedup, name), []

    def run(*args, **kwargs):
        out = step(*args, **kwargs)
        seen.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, name, run)
    return seen


def test_pairs_to_confirm_stay_below_the_members_of_a_group(spark, monkeypatch):
    """Half of a group are near copies of one text, half are just too far from all; their pairs are not tried one by one."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(1, 2) if i % 2 else rng.randint(4, 9)):
            words[at] = f"w{rng.randrange(400)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    expected = plain_components_at(rows, 80)
    assert 20 < len(set(expected.values())) < 120
    seen = counted(monkeypatch, "prefix_pairs")
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), least=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == expected
    assert seen[0] < len(rows)


def test_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(100)]
    texts = [" ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(200))]) for _ in range(60)]
    texts += [texts[0] + " more", texts[1] + " and more"]
    rows = list(enumerate(texts))
    seen = counted(monkeypatch, "hub_pairs")
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), least=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == plain_components_at(rows, 80)
    assert 2 <= seen[0] <= 30


@pytest.mark.parametrize("least", [80, 85])
def test_linked_sets_share_the_bands_asked_of_them(least):
    rng = np.random.default_rng(6)
    for n in (7, 16, 20, 33, 64, 100, 250, 600, 2000):
        for _ in range(150):
            either = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            common = -(-least * n // 100)
            cut = int(rng.integers(common, n + 1))
            a, b = np.sort(either[:cut]), np.sort(np.concatenate([either[:common], either[cut:]]))
            keys = near_dedup.band_keys(np.stack([near_dedup.registers(a), near_dedup.registers(b)]), least)
            assert (keys[0] == keys[1]).sum() >= max(near_dedup.fewest_shared(least, len(a)), near_dedup.fewest_shared(least, len(b)))


def test_fewest_shared_as_a_column(spark):
    sizes = [1, 15, 16, 63, 64, 65, 149, 150, 300, 1000, 4095, 4096, 10**6]
    for least in (80, 85):
        found = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", near_dedup.fewest_of(F.col("n"), least)).collect()
        assert dict(found) == {n: near_dedup.fewest_shared(least, n) for n in sizes}


def test_maybe_among_keeps_all_and_few_others(spark):
    ids = spark.createDataFrame([(i * 7 - 300,) for i in range(1000)] + [(None,)], "id long")
    test = maybe_among(ids)
    assert ids.filter(test(F.col("id"))).count() == 1000
    assert spark.range(10_000, 30_000).filter(test(F.col("id"))).count() < 40
    assert spark.range(10).filter(maybe_among(ids.limit(0))(F.col("id"))).count() == 0


def test_bands_follow_the_threshold():
    assert near_dedup.band_shape(85) == (7, 36) and near_dedup.band_shape(80) == (5, 51)


def test_pipeline_drops_near_copies_between_80_and_85(spark):
    ensure_checkpoint_dir(spark)
    words = [f"w{i}" for i in range(104)]
    changed = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    rows = [(1, " ".join(words)), (2, changed(10, 50)), (3, changed(10, 40, 70))]
    share = [len(plain_set(rows[0][1]) & plain_set(t)) / len(plain_set(rows[0][1]) | plain_set(t)) for _, t in rows[1:]]
    assert 0.80 <= share[0] < 0.85 and share[1] < 0.80
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_one(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    ensure_checkpoint_dir(spark)
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1100)]
    found = dict(near_dedup.components(spark.createDataFrame(chain + star, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1100), 1000)}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    for n, similarity in ((200, 0.9), (2000, 0.5), (20_000, 0.85), (5000, 0.0)):
        union = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        either = int(n * (1 - similarity) / 2)
        a, b = np.unique(union[either:]), np.unique(union[: n - either] if similarity else union[:0])
        if not similarity:
            a, b = np.unique(union[: n // 2]), np.unique(union[n // 2 :])
        value, deviation = near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b), len(a), len(b))
        assert abs(value - similarity) < 6 * max(deviation, 0.02)


def test_compressed_registers_collide_as_often_as_corrected_for():
    rng = np.random.default_rng(5)
    agree = total = 0
    for _ in range(400):
        a, b = (near_dedup.registers(np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))) for _ in "ab")
        agree += int(((a == b) & (a > 0)).sum())
        total += len(a)
    assert agree / total == pytest.approx(near_dedup.chance_match(5000, 5000), rel=0.35)


# ---- top-k ---------------------------------------------------------------------------------------------------------


def plain_top(rows, k, every):
    usable = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(256 * x) for x in v]))
    out = {}
    for q in sorted({i for i, _ in usable if i % every == 0}):
        own = min(v for i, v in usable if i == q)
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v)))), i) for i, v in usable if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("case", ["plain", "ties", "huge"])
def test_top_k_equals_brute_force(spark, case):
    rng = random.Random(31)
    value = {"plain": lambda: rng.gauss(0, 0.3), "ties": lambda: rng.choice([0.0, 0.25, -0.25]), "huge": lambda: rng.gauss(0, 1) * 1e9}[case]
    rows = [(i, [value() for _ in range(6)]) for i in range(300)]
    rows += [(7, None), (8, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9, [float("nan")] * 6), (10, [float("inf")] * 6), (None, [0.1] * 6), (11, []), (12, [0.5, 0.5])]
    rows += [rows[3], rows[20]]
    table = spark.createDataFrame([(i, v, i, 1) for i, v in rows], "vec_id long, embedding array<double>, rank long, score int").repartition(5)
    found = {}
    for r in topk.exact_top_k(table, F.col("vec_id") % 20 == 0, k=5, query_block=4).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert found == plain_top(rows, 5, 20)


def test_top_k_with_few_or_no_candidates(spark):
    table = spark.createDataFrame([(0, [1.0]), (3, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.exact_top_k(table, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 3, 256 * 128)]
    assert topk.exact_top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.exact_top_k(table.filter("vec_id = 0"), F.lit(True)).count() == 0


# ---- url rules -----------------------------------------------------------------------------------------------------


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


URLS = [
    None, "", "example.com/en/x", "://", "http://", "http://COM", "https://com/", "HTTP://www.Example.COM/en/1?x#y", "http://example.com/en/",
    "http://a.example.com/en", "http://example.com?/en/", "http://notexample.com/en/1", "http://a.net/es/1", "http://a.net/es", "http://net/fr/",
    "ftp://x.org#a://b.net/es/", "http://É.net/fr/ü\nz", "http://x.com:80/", "http://.com/", "a://b://net/es/",
]


def test_url_rules_equal_the_plain_form(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://q.com/", "x", "y"), (3, URLS[3], "x", "y")]
    table = spark.createDataFrame(rows, "page_id long, url string, tokens string, verdict string")
    out = url_rules.filter_urls(table, queries.URL_RULES).collect()
    assert len(out) == len(rows)
    urls = {i: u for i, u, *_ in rows}
    for r in out:
        host, path, rule, verdict = plain_verdict(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_url_rules_are_mined_and_pruned(spark):
    rows = [(i, f"http://shop{i % 3}.spam.example.com/en/{i}") for i in range(60)]
    rows += [(100 + i, f"http://blog.fine.example.com/fr/{i}") for i in range(60)]
    rows += [(200, "http://spam.example.org/x"), (201, "http://shop1.spam.example.org/x"), (202, "http://fine.example.org/x"), (203, "http://new.example.org/x")]
    out = {r["page_id"]: (r["verdict"], r["mined"]) for r in url_rules.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert out[200] == out[201] == ("block", True) and out[202] == ("allow", True) and out[203] == ("allow", False)
    labelled = spark.createDataFrame([(["a", "b", "c"], "block")] * 10 + [(["b"], "allow")] * 10, "tokens array<string>, verdict string")
    mined = {tuple(r["tokens"]): (r["verdict"], r["confidence"], r["support"]) for r in url_rules.mine_rules(labelled, 0.01, 0.6).collect()}
    assert mined == {("a",): ("block", 1.0, 10), ("c",): ("block", 1.0, 10)}


def test_url_rules_run_without_python(spark):
    table = spark.createDataFrame([(i, f"http://h{i % 5}.example.com/en/{i}") for i in range(50)], "page_id long, url string")
    plan = url_rules.filter_urls(table, queries.URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_url_rules_of_nothing(spark):
    assert url_rules.filter_urls(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


# ---- the pipeline --------------------------------------------------------------------------------------------------


def pipeline_rows():
    rng = random.Random(41)
    words = {"en": ["the", "and", "thing", "house", "with", "river"], "de": ["der", "und", "straße", "schön", "nicht", "haus"]}
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choices(words[lang], k=60)) + f" tail {i}", lang, "s", 1))
    rows += [(200, "123 456 !", None, "s", 9), (201, None, "en", "s", None), (202, "", None, None, 0)]
    rows += [(300 + i, rows[i][1] + " end", rows[i][2], "s", 1) for i in range(10)] + [rows[4], rows[4]]
    rows += [(400, rows[20][1] + " a secret benchmark passage of the highest order " + rows[21][1], "de", "s", 1)]
    rows += [(500, "the house and the river, mail ann@mail.example.com or +1 (555) 010-2233 " + " ".join(rng.choices(words["en"], k=60)), "en", "s", 1), (None, "the house with the river and the thing", "en", "s", 1)]
    return rows


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = pipeline_rows()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "A secret benchmark passage, of the highest order")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    plain = [(i, t) for i, t, *_ in rows]
    after = [r for r in plain if re.search(r"[^\W\d_]", r[1] or "")]
    assert kept["language"] == sorted(after, key=repr)
    low = plain_components_at([r for r in after if r[0] is not None], corpus_pipeline.NEAR)
    after = [*{r[0]: r for r in after if r[0] is not None and low[r[0]] == r[0]}.values(), *(r for r in after if r[0] is None)]
    assert kept["near_dedup"] == sorted(after, key=repr)
    after = [r for r in after if "secret benchmark passage" not in r[1]]
    assert kept["decontamination"] == sorted(after, key=repr)
    after = [(i, pii.redacted(t, pii.base_spans(t))) for i, t in after]
    assert kept["personal_data"] == sorted(after, key=repr)
    assert any("[email] or [phone]" in t for _, t in after)
    known = bpe.vocabulary(queries.ranks_path())
    expected = {(i, len(known.encode([t])[0])) for i, t in after}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(after) and {(r["doc_id"], r["n_tokens"]) for r in out} == expected


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# ---- whole queries over the driver's small tables --------------------------------------------------------------------


SMALL = "/root/testdata/sf0.001"


def test_decontamination_query_finds_every_verbatim_item(spark):
    docs = [(r["doc_id"], decontam.common_form(r["text"])) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r["item_id"], decontam.common_form(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    verbatim = {(d, i) for d, t in docs for i, x in items if x in t}
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op7_decontamination(spark, SMALL).collect()}
    assert verbatim <= set(found) and all((found[k] == 0) == (k in verbatim) for k in found)


def test_learning_queries_on_their_held_out_rows(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    langs = queries.op5_language_id(spark, SMALL).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in langs)
    held = [r for r in langs if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    quality = queries.op4_quality_fm(spark, SMALL).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in quality)
    held = [r for r in quality if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.8 * len(held)
