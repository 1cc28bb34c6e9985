"""Rules, tokens, language, toxicity and personal data: plain versions, edge cases, held-out accuracy."""

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import _rows
from plain import BASE_KINDS, WORD, base_spans, repeated_words
from pyspark.sql import functions as F

from tallygrid.llm import byte_bpe, language_id, pii, quality_rules, queries, toxicity
from tallygrid.llm.common import fold, read_table
from tallygrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a b c a b c"), (5, "a b c a b c"), (None, "x y"), (7, "word " * 200_000), (8, "12 34 ++ --"), (9, "é漢😀 ok")]


@pytest.fixture(scope="module")
def encoding():
    return byte_bpe.encoding_of(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def test_repeated_words_like_a_plain_count():
    chance = random.Random(1)
    for _ in range(2_000):
        words = [chance.choice("abc") for _ in range(chance.randrange(18))]
        assert quality_rules.repeated_words(words) == repeated_words(words)


def test_ledger_edges(llm_spark, documents):
    rows = quality_rules.apply_policy(quality_rules.ledger(documents(EDGES), carry=("source",)), "v1").collect()
    assert len(rows) == len(EDGES)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_words"] == 0 and not by_id[1]["kept"] and by_id[1]["source"] == "src0"
    assert by_id[5]["n_repeat_words"] == 6
    assert by_id[7]["n_words"] == 200_000 and by_id[7]["failed"] & quality_rules.mask(["repeated_words"])
    assert by_id[9]["word_chars"] == 5
    assert quality_rules.ablations(quality_rules.ledger(documents([]))).count() == 0


def test_ablations_like_a_plain_count(llm_spark):
    rows = quality_rules.ledger(read_table(llm_spark, SF, "documents")).collect()
    for got in QUERIES["quality_rule_ablations"](llm_spark, SF).collect():
        rules = quality_rules.POLICIES[got["policy"]]
        rest = quality_rules.mask([r for r in rules if r != got["rule"]])
        assert got["kept_without"] == sum(not r["failed"] & rest for r in rows)
        assert got["kept"] == sum(not r["failed"] & quality_rules.mask(rules) for r in rows)
        assert got["dropped_alone"] == got["kept_without"] - got["kept"]


def test_clean_documents_are_kept(llm_spark):
    kept = QUERIES["op1_quality_rules"](llm_spark, SF).join(read_table(llm_spark, SF, "labels"), "doc_id")
    assert kept.where("quality = 1 AND NOT base_failed AND NOT kept").count() == 0
    assert kept.where("quality = 0 AND kept").count() == 0


def test_cutting_long_texts_changes_no_token(encoding, monkeypatch):
    chance, letters = random.Random(2), "ab9 .'\n\t\x0b\x1c\x85\xa0é漢s!​ "
    monkeypatch.setattr(byte_bpe, "LONG_RUN", 3)
    monkeypatch.setattr(byte_bpe, "SPACE_RUN", byte_bpe.re.compile(f"[{byte_bpe.SPACES}]{{3,}}"))
    for _ in range(2_000):
        text = "".join(chance.choice(letters) for _ in range(chance.randrange(60)))
        ids = [i for part in byte_bpe.parts(text, 4) for i in byte_bpe.encode_text(encoding, part)]
        assert ids == encoding.encode_ordinary(text)
        assert byte_bpe.decode_ids(encoding, ids) == text.encode()


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 300_000, "x \n" * 200_000, "a" * 300_000, ("ab" + " " * 5_000) * 30])
def test_texts_that_exhaust_the_pattern_engine(encoding, text):
    assert byte_bpe.decode_ids(encoding, byte_bpe.encode_text(encoding, text)) == text.encode()


def test_byte_bpe_query_like_the_library(llm_spark, encoding):
    texts = {r["doc_id"]: r["text"] for r in read_table(llm_spark, SF, "documents").collect()}
    for r in QUERIES["op2_byte_bpe"](llm_spark, SF).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_encode_and_decode_edges(llm_spark, documents):
    docs = documents(EDGES)
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r["decoded"].decode() for r in decoded)) == sorted(t or "" for _, t in EDGES)
    assert byte_bpe.encode(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0
    bad = llm_spark.createDataFrame([(1, np.array([255], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert all(isinstance(bytes(r["decoded"]), bytes) for r in byte_bpe.decode(bad, RANKS, public_tokenizers.PATTERN).collect())


def plain_ngrams(text):
    counts = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram != " ":
                    code = 0
                    for c in gram:
                        code = code << 21 | ord(c)
                    counts[code] = counts.get(code, 0) + 1
    return counts


def test_ngrams_and_distance_like_plain_python(monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 16)
    profiles = language_id.make_profiles({"xx": sorted(plain_ngrams("the cat"))[:9], "yy": sorted(plain_ngrams("der hund"))[:9]}, 9)
    for text in ("the cat sat on the mat and the dog", "Der Hund, der Hund!", "ÀÉ 12 x", "und so weiter und so fort 😀 und"):
        codes, counts = language_id.ngram_counts(text)
        plain = plain_ngrams(text)
        assert dict(zip(codes.tolist(), counts.tolist())) == plain
        top = sorted(plain, key=lambda c: (-plain[c], c))[:9]
        away = []
        for j in range(2):
            ranks = {int(c): int(r) for c, r in zip(profiles.codes, profiles.ranks[:, j])}
            away.append(sum(9 if ranks.get(c, 9) == 9 else abs(ranks[c] - i) for i, c in enumerate(top)))
        lang, score = profiles.predict(text)
        assert lang == ("xx", "yy")[away.index(min(away))] and score == pytest.approx(1 - min(away) / (9 * len(top)))


def test_language_edges(llm_spark, documents):
    docs = documents([(1, "the cat and the dog " * 9, "en"), (2, "der hund und die katze " * 9, "de"), (3, None, "en"), (4, "12 -", "en"), (5, "", None), (6, "die katze", None), (6, "die katze", None)])
    profiles = language_id.fit(docs, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, profiles).collect()}
    assert profiles.languages == ("de", "en")
    assert got[6][0] == "de" and got[1][0] == "en"
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    kept = language_id.reject_unknown(docs, profiles)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 6, 6]
    nothing = language_id.fit(documents([]), F.lit(True))
    assert language_id.predict(docs, nothing).where("lang_pred <> 'und'").count() == 0


def test_language_held_out_accuracy(llm_spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_language_id"](llm_spark, sf).where("held_out").join(read_table(llm_spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.99 * n


def test_features_and_lexicon():
    lexicon = toxicity.Lexicon({"=idiot": (50, 0), "^stup": (40, 1)}, 100, 1_000)
    weights = toxicity.Weights(lexicon, None)
    assert weights["idiot"] > weights["stupid"] > toxicity.STRONG and weights["tree"] == 0
    assert lexicon.weight("idiot", 1) < lexicon.weight("idiot")
    named = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text, weights)))
    assert named("you idiot")["near_second_person"] > 0 == named("that idiot")["near_second_person"]
    assert named("you 1d!0t there")["obfuscated_strong"] > 0 and named("an i.d.i.o.t here")["obfuscated_strong"] > 0
    assert all(v == 0 for v in named(None).values()) and len(named("")) == len(toxicity.FEATURES)


def test_toxicity_edges(llm_spark, documents):
    docs = documents([(i, "you stupid old fool" if i % 3 == 0 else "a fine old day") for i in range(60)] + [(90, None), (91, ""), (92, "stupid " * 30_000), (0, "you stupid old fool")])
    labels = llm_spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (500, 0, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert got[3] == 1 and got[1] == 0 and got[90] == got[91] == 0 and got[92] == 1
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 42
    none = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert toxicity.score(docs, none).where("score <> 0").count() == 0


def test_toxicity_held_out(llm_spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_toxicity"](llm_spark, sf).where("held_out").join(read_table(llm_spark, sf, "labels"), "doc_id").toPandas()
    ranks = got["score"].rank()
    toxic = got["toxic"] == 1
    area = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area >= 0.85 and got["score"].between(0, 1).all()
    assert (got["predicted"][~toxic] == 0).mean() >= 0.95


HARD = [
    "a@b.c%d@e.f x", "a@b.c_d@e.f.g", "é@ü a.b+c@x-y.z.w. 1.2.3.4.5.6.7.8 256.1.1.1 001.0255.3.4 0000256.1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112",
    "4111111111111111", "+1 (443) 555-5793 +12345678 +1234567890123456", "@" * 5_000, "a" * 200_000, "1" * 100_000, "1 " * 50_000, None, "",
    "x@y " * 3 + "a@b.cd " * 3_000, "😀a@b.cd😀 +49 30 1234567.", "1.2.3.4 " * 5_000,
]


def test_pii_like_a_plain_search(llm_spark):
    chance = random.Random(3)
    rows = [(i, t) for i, t in enumerate(HARD)] + [(1_000 + i, "".join(chance.choice("a1.@+- %()2_é") for _ in range(chance.randrange(80)))) for i in range(2_000)]
    rows += [(10_000 + r["doc_id"], r["text"]) for r in read_table(llm_spark, SF, "documents").collect()]
    found = {r["doc_id"]: r for r in pii.find(llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    for doc_id, text in rows:
        assert [(s["kind"], s["start"], s["end"]) for k, _ in BASE_KINDS for s in found[doc_id][k]] == base_spans(text), repr(text)[:200]


def test_added_kinds_need_checks_and_context(llm_spark):
    texts = ["pay to iban DE89370400440532013000", "DE89370400440532013001", 'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"', "hash 0b96a8c8d79c4a5085c919698889f59b72ab7bb6", "ssn 123-45-6789", "part 123-45-6789"]
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (len(r["iban"]), len(r["secret"]), len(r["national_id"])) for r in pii.find(docs).collect()}
    assert got == {0: (1, 0, 0), 1: (0, 0, 0), 2: (0, 1, 0), 3: (0, 0, 0), 4: (0, 0, 1), 5: (0, 0, 0)}


def test_context_is_that_of_the_text(llm_spark, documents):
    key = "0b96a8c8d79c4a5085c919698889f59b"
    texts = ["ssn 123-45-6789, 234-56-7890, 345-67-8901, 456-78-9012", f"keys: {key} {key} {key}", "123-45-6789 234-56-7890 ssn", "123-45-6789 é 234-56-7890  ssn", "123-45-6789", "ssn" + " 123-45-6789" * 3_000]
    found = {r["doc_id"]: r for r in pii.find(documents(list(enumerate(texts)))).collect()}
    masked = {r["doc_id"]: r["text"] for r in pii.redact(documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        expected = []
        for kind, pattern, words in (("national_id", r"\d{3}-\d\d-\d{4}", "ssn"), ("secret", "[0-9a-f]{32}", "key")):
            expected += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if words in text[max(0, m.start() - 40) : m.start()] + " " + text[m.end() : m.end() + 20]]
        assert [(s["kind"], s["start"], s["end"]) for k in ("national_id", "secret") for s in found[i][k]] == expected
        assert masked[i].count("[NATIONAL_ID]") + masked[i].count("[SECRET]") == len(expected)
    assert masked[0].startswith("ssn [NATIONAL_ID], [NATIONAL_ID], [NATIONAL_ID], ") and masked[1] == f"keys: [SECRET] [SECRET] {key}"


def test_iban_before_capitals_and_numbers(llm_spark, documents):
    one, spaced, short, next_one = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "BE68539007547034"
    cases = [
        (f"{one} BIC COBADEFFXXX", [one]), (f"é {spaced} COBADEFFXXX", [spaced]), (f"{one} EUR 500.", [one]), (f"{short} {next_one} X", [short, next_one]),
        (f"REF AB12 {one} EUR {one}", [one, one]), (f"{one}1 EUR", []), (f"{one}x", []), (one[:-1] + "1 EUR 500", []), (one, [one]), (f"AB12 CD34 EF56 GH78 {one} AB12 CD34 EF56 GH78 IJ90", [one]),
    ]
    docs = documents([(i, text) for i, (text, _) in enumerate(cases)])
    found = {r["doc_id"]: r["iban"] for r in pii.find(docs).collect()}
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs, kinds=tuple(k for k in pii.KINDS if k.name == "iban")).collect()}
    for i, (text, values) in enumerate(cases):
        assert [s["value"] for s in found[i]] == values and [text[s["start"] : s["end"]] for s in found[i]] == values, text
        for value in values:
            text = text.replace(value, "[IBAN]", 1)
        assert masked[i] == text


MIXED = [
    ("insurance@acme.com 123-45-6789", "[EMAIL] [NATIONAL_ID]"), ("token abcdef4111111111111111abcdefabcdefab99", "token [SECRET]"),
    ("ssn 123-45-6789, 234-56-7890", "ssn [NATIONAL_ID], [NATIONAL_ID]"), ("iban DE89370400440532013000 BIC COBADEFFXXX", "iban [IBAN] BIC COBADEFFXXX"),
    ("key@a.bc 0b96a8c8d79c4a5085c919698889f59b é1.2.3.4😀", "[EMAIL] [SECRET] é[IP]😀"), ("x" * 999 + "é a@b.cd" + "😀" * 2_500 + "1.2.3.4" + "y" * 1_000, "x" * 999 + "é [EMAIL]" + "😀" * 2_500 + "[IP]" + "y" * 1_000),
    ("a" * 1_000 + " a@b.cd", "a" * 1_000 + " [EMAIL]"), ("", ""), (None, None), ("nothing here", "nothing here"),
]


def test_redaction_takes_every_span_of_find_away(llm_spark, documents):
    texts = [t for t, _ in MIXED] + HARD + [r["text"] for r in read_table(llm_spark, SF, "documents").collect()]
    docs = documents(list(enumerate(texts)))
    found = {r["doc_id"]: sorted((s["start"], s["end"]) for k in pii.KINDS for s in r[k.name]) for r in pii.find(docs).collect()}
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    label = "|".join(rf"\[{k.name.upper()}\]" for k in pii.KINDS)
    for i, text in enumerate(texts):
        parts, at = [], 0
        for start, end in found[i]:
            if start >= at:
                parts.append(text[at:start])
            at = max(at, end)
        if found[i]:
            assert re.split(label, masked[i]) == [p for part in [*parts, text[at:]] for p in re.split(label, part)], text
        else:
            assert masked[i] == text
    assert [masked[i] for i in range(len(MIXED))] == [m for _, m in MIXED]


def test_pii_sql_has_the_rules_of_the_operator(llm_spark, documents, monkeypatch):
    one, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    texts = [t for t, _ in MIXED] + [
        f"{one} {one} X", f"REF AB12 {spaced} EUR {one}", f"{one}1 EUR", f"x{one}", f"{one}_", f"{one}é", f"AB12{one}", f"AB12 CD34 EF56 GH78 {one} AB12 CD34",
        "keys: " + "0b96a8c8d79c4a5085c919698889f59b " * 3, "123-45-6789 234-56-7890 ssn", "000-12-3456 ssn 123-45-6789-1",
    ] + [t for t in HARD if len(t or "") < 1_000]
    docs = documents(list(enumerate(texts)))
    monkeypatch.setattr(queries, "read_table", lambda *_: docs)
    frame = QUERIES["op6_pii"](llm_spark, SF)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
    cursor = con.execute(queries.SQL["op6_pii"])
    columns = [d[0] for d in cursor.description]
    for mine, theirs in zip(_rows(frame.columns, frame.collect()), _rows(columns, cursor.fetchall())):
        assert mine == theirs


def test_redaction_leaves_nothing_and_touches_nothing_else(llm_spark, documents):
    docs = documents([(i, t) for i, t in enumerate(HARD)] + [(100, "clean text 12"), (100, "clean text 12")])
    done = pii.redact(docs)
    assert done.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in done.collect()}
    assert all(not base_spans(t) for t in texts.values())
    assert texts[100] == "clean text 12" and texts[10] is None and texts[11] == ""
    assert texts[0] == "[EMAIL][EMAIL] x"
    assert pii.redact(documents([])).count() == 0


def test_words_are_those_of_the_rules():
    assert WORD.findall("a b c\x0bd\x1ce") == ["a b", "c", "d\x1ce"]


def test_fold_is_the_crc_of_the_id(llm_spark):
    import zlib

    rows = llm_spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_toxicity_sample_is_bounded_when_one_id_has_most_rows(llm_spark, documents):
    rows = [(7, f"you silly fool number {i}") for i in range(400)] + [(i, f"plain words {i}") for i in range(10, 40)]
    labels = llm_spark.createDataFrame([(7, 1, 1)] + [(i, 1, int(i % 3 == 0)) for i in range(10, 40)], "doc_id long, quality int, toxic int")
    seen = []
    real = toxicity.learn_lexicon
    try:
        toxicity.learn_lexicon = lambda sample, *rest: seen.append(sorted((r["doc_id"], r["text"]) for r in sample.collect())) or real(sample, *rest)
        for order in (rows, rows[::-1]):
            toxicity.fit(documents(order), labels, F.lit(True))
    finally:
        toxicity.learn_lexicon = real
    assert [i for i, _ in seen[0]] == [7, *range(10, 40)] and seen[0] == seen[1]


def test_lexicon_and_features_like_a_plain_count(llm_spark):
    docs = read_table(llm_spark, SF, "documents").join(read_table(llm_spark, SF, "labels").select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id")
    rows = [(r["doc_id"], r["text"], r["label"]) for r in docs.collect()]
    counts = {0: {}, 1: {}}
    for _, text, label in rows:
        for entry in set(toxicity.text_entries(text or "")):
            counts[label][entry] = counts[label].get(entry, 0) + 1
    n_pos, n_neg = sum(label == 1 for *_, label in rows), sum(label == 0 for *_, label in rows)
    odds = {}
    for entry, pos in counts[1].items():
        neg = counts[0].get(entry, 0)
        value = np.log((pos + 0.5) / (n_pos - pos + 0.5)) - np.log((neg + 0.5) / (n_neg - neg + 0.5))
        if pos >= 3 and value >= toxicity.LEAST_WEIGHT:
            odds[entry] = (pos, neg, value)
    wanted = sorted(odds, key=lambda e: (-odds[e][2] * np.sqrt(odds[e][0]), e))[: toxicity.LEXICON_SIZE]
    lexicon = toxicity.learn_lexicon(docs.select("text", "label"))
    assert (lexicon.n_pos, lexicon.n_neg) == (n_pos, n_neg) and n_pos > 3
    assert lexicon.counts == {e: odds[e][:2] for e in wanted}
    made = {r["doc_id"]: r["features"].toArray().tolist() for r in toxicity.with_features(docs.select("doc_id", "text"), lexicon, "doc_id").collect()}
    weight = lambda word: max([0.0, *(odds[e][2] for e in toxicity.entries(word) if e in wanted_set)])
    wanted_set, you = set(wanted), toxicity.SECOND_PERSON
    for doc_id, text, _ in rows:
        got = dict(zip(toxicity.FEATURES, made[doc_id]))
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        raw, n, chars = WORD.findall(text or ""), max(len(words), 1), max(len(text or ""), 1)
        weights = [weight(w) for w in words]
        strong = [i for i, w in enumerate(weights) if w >= toxicity.STRONG]
        plain = {
            "log_words": np.log1p(len(words)), "strongest": max(weights, default=0.0), "weight_density": sum(weights) / n,
            "strong_entries": np.log1p(len({words[i] for i in strong})), "strong_density": len(strong) / n,
            "near_second_person": np.log1p(sum(any(w in you for w in words[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i in strong)),
            "second_person_rate": sum(w in you for w in words) / n, "capitals": sum(c.isupper() for c in text or "") / chars,
            "capital_words": sum(w.isupper() for w in raw) / max(len(raw), 1), "exclamations": (text or "").count("!") / chars,
            "punctuation": sum(c in ".,;:!?*#$%&|" for c in text or "") / chars,
        }
        assert {name: got[name] for name in plain} == pytest.approx(plain), doc_id
