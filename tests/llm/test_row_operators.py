"""Operators that judge one row at a time: against plain forms of their definitions, and on the hard rows."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest

from sparkwarden.llm import bpe, decontam, language, license_scan, pii, quality, queries, secret_scan

HARD_TEXTS = [None, "", " ", "\n\n", "a", "é", "\U0001f600" * 40, "word " * 30_000, "x" * 200_000, "1" * 100_000, "@" * 5_000, "'" * 3_000]
HARD_ROWS = [(i, t) for i, t in enumerate(HARD_TEXTS)] + [(None, "Ann mails ann@mail.example.com"), (3, "twice"), (3, "twice")]


def hard_table(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, None, None, None if t is None else len(t), "x", 1.5, 7) for i, t in HARD_ROWS]
    names = "doc_id long, text string, lang string, source string, n_chars long, y string, score double, id long"
    return spark.createDataFrame(rows, names)


def empty_table(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df):
    out = {}
    for row in df.collect():
        out.setdefault(row["doc_id"], []).append(row)
    return out


# ---- licences ------------------------------------------------------------------------------------------------------


def plain_license_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base_matches_the_plain_form():
    rng = random.Random(5)
    pieces = ["MIT", "license", "Licence", "GNU", "general", "public", "apache", "cc", "by", "CC-BY", "é", ",", "\n", "\x7f", "ſ", "K", "x1"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "-", "", "\t"]) for _ in range(rng.randint(0, 14)))
        assert license_scan.scan_text(text)[:5] == plain_license_base(text), text


@pytest.mark.parametrize(
    ("text", "postfix", "labels", "free"),
    [
        ("MIT", "MIT", {"mit"}, 0.9),
        ("MIT OR GPL-3.0-only", "MIT GPL-3.0-only or", {"mit", "gpl"}, 0.9),
        ("MIT AND GPL-2.0", "MIT GPL-2.0 and", {"mit", "gpl"}, 0.2),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", "GPL-2.0 Classpath-exception-2.0 with MIT or", {"mit", "gpl"}, 0.9),
        ("MIT OR (BSD-3-Clause AND MPL-2.0)", "MIT BSD-3-Clause MPL-2.0 and or", {"mit", "bsd", "mpl"}, 0.9),
        ("Apache-2.0 */", "Apache-2.0", {"apache"}, 0.9),
        ("MIT OR", "MIT", {"mit"}, 0.9),
        ("MIT and see below", "MIT see and", {"mit"}, 0.0),
    ],
)
def test_license_expressions(text, postfix, labels, free):
    assert license_scan.parse_expression(text) == (postfix, labels, pytest.approx(free))


@pytest.mark.parametrize("text", ["", "(", "OR", "AND MIT", ")", "%%"])
def test_no_license_expression(text):
    assert license_scan.parse_expression(text) is None


def plain_prefix(tokens):
    """The longest prefix that the parser accepts, tried from the longest on."""
    for size in range(len(tokens), 0, -1):
        try:
            license_scan.to_postfix(tokens[:size])
        except ValueError:
            continue
        return size
    return 0


def test_longest_expressions_equal_trying_all_prefixes():
    rng = random.Random(17)
    for _ in range(3000):
        tokens = rng.choices(["MIT", "x", "or", "AND", "with", "(", ")"], k=rng.randint(0, 14))
        assert license_scan.complete(tokens) == plain_prefix(tokens), tokens


def test_long_broken_expressions_take_one_pass():
    for text in ("MIT OR " * 100_000 + ") " * 100_000, "( " * 200_000 + "MIT", "MIT OR " * 200_000):
        assert license_scan.parse_expression(text) is None or license_scan.parse_expression(text)[1] == {"mit"}


def test_license_tags_add_labels():
    row = license_scan.scan_text("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC\ncode")
    assert row[4] == "" and row[5] == "apache,isc,mit" and row[6] == 0.999875 and row[7] == "MIT Apache-2.0 or ISC and"


# ---- personal data -------------------------------------------------------------------------------------------------


def plain_pii_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_matches_the_plain_form():
    rng = random.Random(6)
    pieces = ["a", "b.c", "@", ".", "com", "-", "+", "1", "12", "255", "256", "4465758382889437", " ", "(", ")", "é", "0", "%", "_", "٣", "4"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(text) == plain_pii_base(text), text


def test_pii_adds_spelt_out_and_local_forms_and_leaves_prose_alone(spark):
    texts = spark.createDataFrame([("The house of the rising sun, 12 of them in 2021.",)], "text string")
    model = pii.fit(texts)
    kinds = lambda t: [s[0] for s in pii.find_spans(t, model)[1]]
    assert kinds("my phone is 030 1234 5678.") == ["phone_local"]
    assert kinds("SSN: 219-09-9999 thanks") == ["ssn"]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 ") == ["iban"]
    assert kinds("write to ann.lee at mail dot com") == ["email_text"]
    assert kinds("order 030 1234 5678 of it") == []
    assert kinds("we look at this and that, version 12.50.99 of it") == []
    assert kinds("mail a@b.de, not ann.lee at mail") == ["email"]


def test_pii_redaction():
    assert pii.redacted("a@b.de calls +49 (30) 1234567!", pii.base_spans("a@b.de calls +49 (30) 1234567!")) == "[email] calls [phone]!"
    assert pii.redacted("plain", []) == "plain"


# ---- secrets -------------------------------------------------------------------------------------------------------


def plain_secret_base(text):
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    out = []
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def test_secret_base_matches_the_plain_form():
    rng = random.Random(7)
    pieces = ["toKen", "secret", "ſecret", "api_Key", "apikey", "PASSWORD", "=", ":", " ", '"', "'", "abc", "d3ad", "AKIA", "ABCDEFGH", "0f" * 13, "\n", "é"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert secret_scan.base_spans(text) == plain_secret_base(text), text


def test_secret_assignments_and_constants():
    def added(text):
        return [(k, text[s:e]) for k, s, e in secret_scan.method_spans(text)]

    key = "s7Gk2pQ9xLm4Vz81"
    assert added(f'client_secret_value = "{key}"') == [("literal", key)]
    assert added(f'a = "{key}"\nb = a\nDB_PASSPHRASE = b') == [("constant", key)]
    assert added(f'a = "{key}"\na = "plain"\npassphrase = a') == []
    assert added('passphrase = "changeme"\nsecret_name = "database"') == []
    assert added(f"export SIGNING_TOKEN={key}\n") == [("literal", key)]
    assert added("the secret: we never knew, the token = of love") == []
    chain = "v0 = 'Zk93mQ0xPw27Lr'\n" + "".join(f"v{i} = v{i - 1}\n" for i in range(1, 3000)) + "password = v2999"
    assert added(chain) == [("constant", "Zk93mQ0xPw27Lr")]


# ---- language and quality ------------------------------------------------------------------------------------------


def test_language_learns_and_rejects(spark):
    rng = random.Random(8)
    words = {"en": ["the", "and", "thing", "house", "with"], "de": ["der", "und", "straße", "schön", "nicht"], "fr": ["le", "été", "que", "garçon", "où"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(3, 40))), lang) for i, lang in enumerate(sorted(words) * 60)]
    rows += [(1000, "12 34 !", None), (1001, None, "en"), (1002, "", "en"), (1003, "der und nicht der straße", None), (None, "the house", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = by_id(queries.language.identify(docs, queries.F.col("doc_id") % 4 != 2, queries.F.col("doc_id") % 4 == 2))
    truth = {i: lang for i, _, lang in rows}
    assert all(out[i][0]["lang_pred"] == truth[i] for i in range(180))
    assert [out[i][0]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert out[1000][0]["rejected"] and out[1000][0]["score"] == 0 and out[None][0]["lang_pred"] == "en"


def test_language_centroids_and_cuts_come_from_all_training_texts(spark):
    rows = [(str(i), f"{word} w{chr(97 + i % 26)}{chr(97 + i // 26)} zq", lang) for i in range(120) for lang, word in (("a", "some text"), ("b", "más señales"))]
    texts = spark.createDataFrame(rows, "id string, text string, lang string")
    model = language.fit(texts, sample_per_language=4, centroids=1)
    for place, lang in enumerate("ab"):
        units = language.unit_rows(np.array([language.gram_counts(t) for _, t, l in rows if l == lang]), model.idf).sum(axis=0)
        assert np.allclose(model.rows[place], units / np.linalg.norm(units), atol=1e-4)
    assert model.cuts[language.length_bin(language.gram_counts(rows[0][1]))] > 0.2
    split = language.fit(texts.repartition(5), sample_per_language=4, centroids=1)
    assert (split.rows == model.rows).all() and (split.cuts == model.cuts).all()


def test_language_pieces_have_the_counts_of_their_own_text():
    head = "Ab, 12 -- c-d eé\u0301f \u3000 日本 x1y (z) ! last one.. 7"
    words, want = head.split(), []
    for size in (1, 2, 4, 8):
        want += [c for start in {0, len(words) // size // 2 * size} if (c := language.gram_counts(" ".join(words[start : start + size]))) is not None]
    assert np.array_equal(list(language.piece_counts(head)), want)
    assert not [*language.piece_counts("")] + [*language.piece_counts("1 2 3")] + [*language.piece_counts("word")]


def plain_runs(text, model):
    """Length bin and cosine of the runs of 1, 2, 4, ... words of a whole text, each worked out from its own text."""
    words, size, out = text.split(), 1, []
    while True:
        for start in range(0, len(words), size):
            longer = size == 1 or start + size // 2 < len(words)
            if longer and (counts := language.gram_counts(" ".join(words[start : start + size]))) is not None:
                out.append((language.length_bin(counts), float((language.unit_rows(counts[None], model.idf) @ model.rows.T).max())))
        if size >= len(words):
            return out
        size *= 2


@pytest.mark.parametrize("segment", [1 << 14, 4])
def test_language_cuts_come_from_all_runs_of_whole_texts(segment, monkeypatch):
    monkeypatch.setattr(language, "_SEGMENT", segment)
    monkeypatch.setattr(language, "_CELLS", 40)
    rng, rnd = random.Random(5), np.random.default_rng(5)
    model = language.Centroids(("a",), np.zeros(3, np.int64), language.unit_rows(rnd.integers(0, 3, (3, language.SLOTS)), np.ones(language.SLOTS)), rnd.uniform(1, 5, language.SLOTS), 0.0)
    texts = [" ".join("".join(rng.choices("abcdé .1", k=rng.randint(1, 9))) for _ in range(n)) for n in (1, 2, 3, 37, 700)]
    texts += ["Ab, 12 -- c-d eé\u0301f \u3000 日本 x1y (z) ! last one.. 7", "", " ", "1 2 3", "word", "\ud800a b", "x" * 3000, "a " * 50]
    got = [np.concatenate([np.zeros(0, np.int64), *language.reached_by_runs([t], model.rows.astype(float), model.idf)]) for t in texts]
    for text, found in zip(texts, got):
        want = sorted(b * (language.LEVELS + 1) + cosine * language.LEVELS for b, cosine in plain_runs(text, model))
        assert len(found) == len(want) and np.allclose(np.sort(found) + 0.5, want, rtol=0, atol=0.51)
    together = np.concatenate(language.reached_by_runs(texts, model.rows.astype(float), model.idf))
    assert np.array_equal(np.sort(together), np.sort(np.concatenate(got)))


def test_language_cuts_count_words_wherever_they_stand(spark):
    place = language.length_bin(language.gram_counts("stone"))
    fit = lambda text: language.fit(spark.createDataFrame([(str(i), text, "a") for i in range(4)], "id string, text string, lang string"), centroids=1)
    front, back = (fit(text).cuts[place] for text in ("zqxjk wvkpf " * 32 + "stone " * 512, "stone " * 512 + "zqxjk wvkpf " * 32))
    assert 0 < front == back


def test_language_rejects_what_is_far_from_every_centroid():
    counts = language.gram_counts("aaa bbb")
    model = language.Centroids(("x",), np.array([0]), language.unit_rows(counts[None], np.ones(language.SLOTS)), np.ones(language.SLOTS), 0.5)
    assert language.predict_texts(["aaa bbb", "日本語のテキスト"], model)[2] == [False, True]


def test_language_rejects_other_languages_and_junk_but_keeps_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("doc_id < 100000")
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve kardeşçe davranırlar.",
        "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được ban cho lý trí.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        base64.b64encode(random.Random(6).randbytes(200)).decode(),
        " ".join("".join(random.Random(i).choices("bcdfghjklmnpqrstvwxz", k=6)) for i in range(40)),
    ]
    short = ["Die.", "The", "La que", "Et des", "und der", "los de la", "the of and", "Die Die Die Die Die Die Die Die"]
    extra = spark.createDataFrame([(200_000 + i, t, None) for i, t in enumerate(other + short)], docs.schema)
    out = by_id(language.identify(docs.unionByName(extra), ~queries.share(queries.F.col("doc_id"), 2, 4), queries.share(queries.F.col("doc_id"), 2, 4)))
    assert [out[200_000 + i][0]["rejected"] for i in range(len(other))] == [True] * len(other)
    assert [out[200_000 + len(other) + i][0]["rejected"] for i in range(len(short))] == [False] * len(short)
    own = [r[0] for i, r in out.items() if i is not None and i < 200_000 and r[0]["lang_pred"] != "und"]
    assert sum(r["rejected"] for r in own) <= 0.002 * len(own)


def test_factorisation_identity():
    rng = np.random.default_rng(3)
    model = quality.Machine(0.3, rng.normal(size=quality.SLOTS), rng.normal(size=(quality.SLOTS, 4)))
    slots, values = quality.features("Some text, with WORDS!", 22)
    fast, _ = model.raw(*quality.stack([(slots, values)]))
    slow = model.bias + model.linear[slots] @ values
    for i in range(len(slots)):
        for j in range(i):
            slow += (model.factors[slots[i]] @ model.factors[slots[j]]) * values[i] * values[j]
    assert fast[0] == pytest.approx(slow)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choices(["the", "house", "stands", "near", "river", "and", "calm."], k=60))
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choices(["buy", "now", "win", "free", "cash"], k=60))
    rows = [(i, good() if i % 3 else bad(), 300 if i % 2 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 400, 2)], "id long, label int")
    out = by_id(quality.score_quality(docs, labels, queries.F.col("doc_id") % 2 == 1))
    assert all(out[i][0]["predicted"] == int(i % 3 > 0) for i in range(400))
    none = by_id(quality.score_quality(docs, labels.limit(0), queries.F.lit(True)))
    assert {r["score"] for rows in none.values() for r in rows} == {0.5}


# ---- byte-level BPE ------------------------------------------------------------------------------------------------


def test_bpe_equals_the_public_library():
    import public_tokenizers
    import tiktoken

    path = queries.ranks_path()
    mine = bpe.vocabulary(path)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    rng = random.Random(10)
    alphabet = "aslrevtdmSTL1٣½ \t\n\r  '’é中!?.-_\U0001f600\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))) for _ in range(5000)]
    texts += ["", "a" * 5000, "ab" * 3000, "<|endoftext|>", "it's we'll you've 'tis 'S'", " " * 300 + "x", "x" + "\n" * 300]
    for text, ids in zip(texts, mine.encode(texts)):
        assert ids.tolist() == plain.encode_ordinary(text), text
        assert mine.decode(ids) == text.encode()


def test_bpe_classes_equal_the_library():
    import public_tokenizers
    import tiktoken

    mine = bpe.vocabulary(queries.ranks_path())
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    points = [c for c in [*range(0x3100), *range(0x3100, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}a1{chr(c)}1.{chr(c)}. {chr(c)} " for c in points]
    for text, ids in zip(texts, mine.encode(texts)):
        assert ids.tolist() == plain.encode_ordinary(text), ascii(text)


def test_bpe_round_trip_equals_encode_then_decode(spark):
    path = queries.ranks_path()
    apart = {r["doc_id"]: r for r in bpe.decode(bpe.encode(hard_table(spark), path), path).filter("doc_id <> 3").collect()}
    for row in bpe.round_trip(hard_table(spark), path).filter("doc_id <> 3").collect():
        other = apart[row["doc_id"]]
        assert row["n_tokens"] == other["n_tokens"] and row["ids_sha256"] == hashlib.sha256(other["ids"]).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(other["decoded"]).hexdigest()


def test_bpe_merges_agree_for_short_and_long_pieces(monkeypatch):
    known = bpe.vocabulary(queries.ranks_path())
    rng = random.Random(12)
    for _ in range(2000):
        piece = bytes(rng.choice(b" etaoinshrdluTHE\xc3\xa9") for _ in range(rng.randint(2, 60)))
        assert bpe.merge_short(piece, known.ranks, known.joins) == bpe.merge_long(piece, known.ranks)


def test_bpe_long_texts_are_cut_where_tokens_start(monkeypatch):
    known = bpe.vocabulary(queries.ranks_path())
    text = "it's  a  long 'text'  with\n spaces " * 40
    whole = known.encode([text])[0].tolist()
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 50)
    assert len(list(bpe.cut_long(text))) > 5 and known.encode([text, "a b"])[0].tolist() == whole


def test_bpe_ends_mark_the_tokens(spark):
    row = bpe.decode(bpe.encode(spark.createDataFrame([(1, "Grüße, 世界!")], "doc_id long, text string"), queries.ranks_path()), queries.ranks_path()).first()
    ids, ends = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["ends"], "<u4")
    known = bpe.vocabulary(queries.ranks_path())
    assert [bytes(row["decoded"][a:b]) for a, b in zip([0, *ends], ends)] == [known.tokens[i] for i in ids]
    assert bytes(row["decoded"]).decode() == "Grüße, 世界!" and row["n_tokens"] == len(ids)


# ---- decontamination -----------------------------------------------------------------------------------------------


def fewest_edits(pattern, text):
    """Sellers' algorithm over whole columns."""
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for c in text:
        before, column[0] = column[:], 0
        for i, p in enumerate(pattern, 1):
            column[i] = min(before[i] + 1, column[i - 1] + 1, before[i - 1] + (p != c))
        best = min(best, column[-1])
    return best


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + "q" + text[at:], text[:at] + text[at + 1 :], text[:at] + "z" + text[at + 1 :]])
    return text


def test_decontamination_against_whole_column_distances():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(2, 7)))
    items = decontam.prepared([(i, " ".join(word() for _ in range(rng.randint(5, 14)))) for i in range(12)], 0.1, 20)
    pieces = decontam.automaton_of(items)
    for _ in range(150):
        item = rng.choice(items)
        text = " ".join([word(), edited(rng, item.text, rng.randint(0, item.budget + 3)), *(word() for _ in range(8))])
        found = {i: (edits, start, end) for i, edits, start, end in decontam.find_items(text, items, pieces)}
        for i, other in enumerate(items):
            fewest = fewest_edits(other.text, text)
            assert (i in found) == (fewest <= other.budget)
            if i in found:
                edits, start, end = found[i]
                assert edits == fewest and fewest_edits(other.text, text[start:end]) == edits


def test_decontamination_in_blocks_and_on_odd_items(spark):
    docs = spark.createDataFrame([(1, "x THE quick-brown fox jumps over it"), (2, "nothing here"), (None, "the quick brown fox jumps over"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame(
        [(7, "The quick brown fox jumps, over"), (7, "The quick brown fox jumps, over"), (8, "short"), (9, None), (None, "no such words in any of the documents")],
        "item_id long, text string",
    )
    found = sorted(decontam.find_benchmark(docs, items, block_chars=10).collect(), key=repr)
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in found] == [(1, 7, 0), (None, 7, 0)]
    assert [r["doc_id"] for r in decontam.decontaminate(docs, items).collect()] == [2, 3]
    assert decontam.find_benchmark(docs, items.limit(0)).count() == 0 and decontam.decontaminate(docs, items.limit(0)).count() == 4


# ---- hard rows -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["license", "pii", "quality", "language", "bpe", "secrets"])
def test_hard_rows_and_empty_tables(spark, name):
    labels = spark.createDataFrame([(2, 1), (4, 0), (None, 1)], "id long, label int")
    run = {
        "license": lambda df: license_scan.scan_licenses(df),
        "pii": lambda df: pii.find_personal_data(df),
        "quality": lambda df: quality.score_quality(df, labels, queries.share(queries.F.col("doc_id"), 1, 3)),
        "language": lambda df: language.identify(df, queries.F.col("doc_id") > 0, queries.share(queries.F.col("doc_id"), 2, 4)),
        "bpe": lambda df: bpe.decode(bpe.encode(df, queries.ranks_path()), queries.ranks_path()),
        "secrets": lambda df: secret_scan.scan_secrets(df),
    }[name]
    out = by_id(run(hard_table(spark)))
    assert {k: len(v) for k, v in out.items()} == {**dict.fromkeys(range(len(HARD_TEXTS)), 1), 3: 3, None: 1}
    assert run(empty_table(spark)).count() == 0
    if name == "pii":
        assert out[0][0]["base_sha256"] == out[1][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
        assert out[None][0]["n_email"] == 1
    if name == "bpe":
        assert all(bytes(out[i][0]["decoded"]) == (t or "").encode() for i, t in enumerate(HARD_TEXTS) if i != 3)
