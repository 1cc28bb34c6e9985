"""Chat formatting, near copies, packing, nearest neighbours, sharding and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from plain import near_copies
from pyspark.sql import functions as F

from tallygrid.llm import byte_bpe, chat_format, chosen_path, kmeans_tree, packing, ring_sharding
from tallygrid.llm.common import read_table
from tallygrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")


@given(st.text(alphabet="<|\\a>\n", max_size=30))
@settings(max_examples=300, deadline=None)
def test_escape_is_undone_and_hides_controls(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert "<|" not in chat_format.escape(text)


def test_mask_by_prefix_sums():
    ids, mask = chat_format.assemble([([1], False), ([2, 3], True), ([], True), ([4], False), ([5], True)])
    assert ids.tolist() == [1, 2, 3, 4, 5] and mask.tolist() == [False, True, True, False, True]


def test_conversations_come_back(llm_spark):
    nasty = [None, "", "<|turn|>", "a<|end|>\\<|says|>", "<\\|x|>", "é漢😀\n"]
    rows = [(c, t, role, nasty[(c + t) % 6], "x") for c in range(12) for t, role in enumerate(["system", "user", "assistant", None])] + [(None, 0, "assistant", "lost id", "x"), (3, None, "user", "no turn", "x"), (3, 0, "system", nasty[3], "x")]
    table = llm_spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    made = chat_format.read_back(chat_format.assemble_conversations(chat_format.format_turns(table, RANKS, PATTERN)), RANKS, PATTERN).collect()
    assert len(made) == 13
    for r in made:
        own = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text, _ in rows if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for _, _, role, text in own]
        assert "".join(r["loss_texts"]) == "".join(text for _, _, role, text in own if role == "assistant")
        assert r["formatted"].count("<|end|>") == len(own)
    empty = table.where("false")
    assert chat_format.assemble_conversations(chat_format.format_turns(empty, RANKS, PATTERN)).count() == 0


def plain_digest(turns):
    said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
    lost = "".join(text for role, text in turns if role == "assistant")
    return len(turns), said, len(lost), hashlib.sha256(lost.encode()).hexdigest()


def test_folded_rows_say_what_the_turns_said(llm_spark):
    """A conversation far longer than a batch, one with ties, repeats and nulls, one without an id, one of empty texts."""
    long = [(1, n, "assistant" if n % 2 else "user", f"<|end|> number {n}") for n in range(2500)]
    odd = [(2, None, None, "first"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "assistant", "<\\|end|>"), (2, 1, "user", "a"), (3, 0, "assistant", None)]
    rows = long + odd + [(None, 0, "assistant", "no id")]
    table = llm_spark.createDataFrame(random.Random(3).sample(rows, len(rows)), "conv_id long, turn long, role string, text string")
    turns = chat_format.format_turns(table, RANKS, PATTERN)
    folded = {r.conv_id: r for r in chat_format.fold_conversations(chat_format.ordered_turns(turns), RANKS, PATTERN).collect()}
    whole = {r.conv_id: r for r in chat_format.read_back(chat_format.assemble_conversations(turns), RANKS, PATTERN).collect()}
    assert set(folded) == set(whole) == {1, 2, 3, None}
    for conv_id, row in folded.items():
        own = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv_id)
        said = [(role, text) for _, role, text in own]
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == plain_digest(said)
        assert [tuple(t) for t in whole[conv_id].turns] == said
        assert row.formatted_chars == len(whole[conv_id].formatted)
    assert chat_format.fold_conversations(chat_format.ordered_turns(turns.limit(0)), RANKS, PATTERN).count() == 0


def edited(words, chance, share):
    return [chance.choice("pqrs") + str(chance.randrange(99)) if chance.random() < share else w for w in words]


def made_up(seed, groups=12):
    chance = random.Random(seed)
    rows, n = [], 0
    passage = [f"common{i}" for i in range(40)]
    for g in range(groups):
        base = [f"w{chance.randrange(10_000)}" for _ in range(chance.randrange(30, 200))]
        for _ in range(chance.randrange(1, 12)):
            rows.append((n, " ".join(edited(base, chance, chance.choice([0, 0.005, 0.01, 0.03])))))
            n += 1
        rows.append((n, " ".join(passage + base[: chance.randrange(10, 30)] + [f"own{n}"])))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "one two"), (n + 4, "one"), (n + 5, " \n"), (None, "no id at all here now"), (n + 6, "a b c d e f"), (n + 7, "a b c d e f a b c d e f")]
    return rows


@pytest.mark.parametrize("block", [400, 3])
def test_near_copies_like_all_pairs(llm_spark, documents, block):
    rows = made_up(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["class_size"]) for r in chosen_path.join(documents(rows), block=block).collect()}
    assert got == near_copies(rows)


def test_near_copies_query_like_all_pairs(llm_spark):
    rows = [(r["doc_id"], r["text"]) for r in read_table(llm_spark, SF, "documents").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["class_size"]) for r in QUERIES["op8_chosen_path"](llm_spark, SF).collect()}
    assert got == near_copies(rows)


def test_keep_one(llm_spark, documents):
    base = " ".join(f"w{i}" for i in range(60))
    docs = documents([(5, base), (3, base), (3, base), (4, base + " more"), (9, "something else altogether is here"), (7, None), (8, "")])
    kept = chosen_path.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8, 9]
    assert chosen_path.keep_one(documents([])).count() == 0


def test_keep_one_when_an_id_has_several_texts(llm_spark, documents):
    a, b, c = (" ".join(f"{letter}{i}" for i in range(60)) for letter in "abc")
    rows = [(5, a), (5, b), (3, b + " more"), (7, a + " more"), (2, a[:-30] + " x y z"), (2, c), (2, c), (2, c + " more"), (2, None)]
    kept = sorted((r["doc_id"], r["text"] or "") for r in chosen_path.keep_one(documents(rows[:4])).collect())
    assert kept == [(3, b + " more"), (5, a)]
    kept = [(r["doc_id"], r["text"]) for r in chosen_path.keep_one(documents(rows)).collect()]
    assert len(kept) == 4 and {k for k, _ in kept} == {2, 3}
    assert sorted((text or "-")[0] for _, text in kept) == ["-", "a", "b", "c"]


def test_token_sets_meet_by_id_and_set(llm_spark, documents):
    texts = [" ".join(f"t{n}w{i}" for i in range(9)) for n in range(6)]
    docs = documents([(1, t) for t in texts] + [(1, texts[0])] + [(2, texts[1])])
    wanted = chosen_path.signatures(docs).where("doc_id = 1").dropDuplicates(["sid"]).withColumn("copies", F.lit(1).cast("long"))
    made = chosen_path.token_sets(docs, wanted, "doc_id", "text", chosen_path.SHINGLE)
    assert sorted(r["sid"] for r in made.collect()) == sorted(r["sid"] for r in wanted.collect())
    plan = made._jdf.queryExecution().analyzed().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert join.count("sid#") == 2 and join.count("doc_id#") == 2


def test_components_of_a_long_chain(llm_spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)]
    got = {r["node"]: r["root"] for r in chosen_path.components(llm_spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}


def test_overlaps_agree_either_way():
    random_ = np.random.default_rng(5)
    sets = [np.unique(random_.integers(0, 60, 30).astype(np.uint64)) for _ in range(12)]
    a, b = np.triu_indices(12, 1)
    plain = [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(a, b)]
    assert chosen_path._overlaps(sets, a, b).tolist() == plain
    assert chosen_path._overlaps(sets, a[:5], b[:5]).tolist() == plain[:5]


def test_words_like_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    words = packing.Words(open(WORDS, "rb").read())
    chance, letters = random.Random(6), "aB'sStTléÉß×÷ÿ 12 \n\t.!?#@_<|endoftext|>漢字 ́e\x1c\x85\xa0ªº²½İΙς’​\x00\x7f"
    for _ in range(2_000):
        text = "".join(chance.choice(letters) for _ in range(chance.randrange(40)))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 64), max_size=60))
@settings(max_examples=200, deadline=None)
def test_pack_fills_every_sequence(lengths):
    made = packing.pack(lengths, 64)
    pieces, rows = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in made:
        pieces[doc].append((start, length))
        rows[sequence].append((offset, length))
    for doc, n in enumerate(lengths):
        assert [s for s, _ in sorted(pieces[doc])] == [sum(length for _, length in sorted(pieces[doc])[:i]) for i in range(len(pieces[doc]))]
        assert sum(length for _, length in pieces[doc]) == n
    for parts in rows.values():
        total = sum(length for _, length in parts)
        assert total == 64 or total & (total - 1) == 0
        assert [o for o, _ in sorted(parts)] == [sum(length for _, length in sorted(parts)[:i]) for i in range(len(parts))]


def test_costs_are_balanced():
    chance = random.Random(7)
    made = packing.pack([chance.randrange(20, 400) for _ in range(3_000)], 2_048)
    spent = Counter()
    for _, _, length, sequence, _ in made:
        spent[sequence] += packing.cost(length)
    full = sorted(spent.values())[20:]
    assert full[-1] <= 1.1 * full[0]


def test_packed_documents(llm_spark, documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    rows = [(1, None), (2, ""), (3, "Hello, World's end! " * 900), (4, "word"), (4, "word"), (None, "x")]
    made = packing.pack_documents(documents(rows), WORDS, with_ids=True).collect()
    for doc_id, text in dict(rows).items():
        expected = whole.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((r["start"], r["length"], bytes(r["ids"]), r["ids_crc32"], r["doc_tokens"]) for r in made if r["doc_id"] == doc_id)
        if doc_id != 4:
            assert np.frombuffer(b"".join(o[2] for o in own), "<u4").tolist() == expected
        assert all(zlib.crc32(o[2]) == o[3] and o[4] == len(expected) for o in own)
    seen = defaultdict(list)
    for r in made:
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(max(o + n for o, n in s) == sum(n for _, n in s) for s in seen.values())
    assert packing.pack_documents(documents([]), WORDS).count() == 0


def vectors(llm_spark, rows):
    return llm_spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, query string")


def test_neighbours_edges(llm_spark):
    bad = [(100, None, 0, ""), (101, [0.0, 0.0], 0, ""), (102, [float("nan"), 1.0], 0, ""), (103, [1.0, None], 0, ""), (None, [1.0, 1.0], 0, ""), (104, [1.0], 0, ""), (105, [float("inf"), 1.0], 0, "")]
    good = [(0, [1.0, 0.0], 0, ""), (7, [1.0, 0.0], 0, ""), (5, [1.0, 0.0], 0, ""), (20, [0.5, 0.5], 0, ""), (3, [-1.0, 0.0], 0, "")]
    got = kmeans_tree.search(vectors(llm_spark, good + bad), F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 5, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 5, 0.5), (20, 3, 7, 0.5)]
    assert kmeans_tree.search(vectors(llm_spark, good[:1]), F.col("vec_id") % 20 == 0).count() == 0
    assert kmeans_tree.search(vectors(llm_spark, []), F.lit(True)).count() == 0


def test_recall_against_brute_force(llm_spark):
    table = read_table(llm_spark, "/root/testdata/sf0.1", "embeddings")
    data = table.toPandas()
    ids, matrix = data["vec_id"].to_numpy(), np.array(data["embedding"].tolist(), dtype=np.float64)
    found = defaultdict(dict)
    for r in QUERIES["op5_kmeans_tree"](llm_spark, "/root/testdata/sf0.1").collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = matrix @ matrix[q]
        scores[q] = -9
        top = ids[np.argsort(-scores)[:20]]
        hits += sum(v in found[ids[q]] for v in top)
        assert len(found[ids[q]]) == 20 and all(found[ids[q]][v] == pytest.approx(scores[ids == v][0], abs=1e-12) for v in list(found[ids[q]])[:2])
    assert hits >= 0.9 * 20 * len(found)


def test_tree_groups_leave_results_alone(llm_spark):
    random_ = np.random.default_rng(8)
    table = vectors(llm_spark, [(i, v.tolist(), 0, "") for i, v in enumerate(random_.normal(size=(400, 4)).round(1))])
    rows = kmeans_tree.usable(table, "vec_id", "embedding", None)
    tree, index = kmeans_tree.build(rows, 5, leaf_rows=20)
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"))
    key = lambda df: sorted(map(tuple, df.collect()))
    exact = key(kmeans_tree.brute_force(index, queries, 5))
    assert tree.leaves > 4
    assert key(kmeans_tree.look_up(index, kmeans_tree.visit(queries, tree, tree.leaves), 5, group_rows=7)) == exact


def plain_neighbours(rows, is_query, k):
    """Ids by the best pair of their vectors."""
    best = defaultdict(dict)
    for q, a in rows:
        if is_query(q):
            for c, b in rows:
                if c != q:
                    score = sum(x * y for x, y in zip(a, b))
                    best[q][c] = max(best[q].get(c, score), score)
    return sorted((q, rank, c, s) for q, held in best.items() for rank, (c, s) in enumerate(sorted(held.items(), key=lambda m: (-m[1], m[0]))[:k], 1))


def test_a_repeated_id_takes_one_place(llm_spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, i / 128]) for i in range(30)] + [(i, [0.5, i / 128]) for i in range(2, 42)]
    got = kmeans_tree.search(vectors(llm_spark, [(*r, 0, "") for r in rows]), F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == plain_neighbours(rows, lambda i: i == 0, 20) and len(got) == 20


def test_repeated_ids_like_brute_force(llm_spark):
    random_ = np.random.default_rng(4)
    rows = [(int(i), (v / 4).tolist()) for i, v in zip(random_.integers(0, 120, 500), random_.integers(-40, 41, (500, 3)))]
    table = vectors(llm_spark, [(*r, 0, "") for r in rows + rows[:40]])
    used = kmeans_tree.usable(table, "vec_id", "embedding", None)
    tree, index = kmeans_tree.build(used, 9, leaf_rows=30)
    queries = used.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")).distinct()
    wanted = plain_neighbours([r for r in rows if any(r[1])], lambda i: i % 20 == 0, 9)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert tree.leaves > 4 and key(kmeans_tree.brute_force(index, queries, 9)) == wanted
    assert key(kmeans_tree.look_up(index, kmeans_tree.visit(queries, tree, tree.leaves), 9, group_rows=11, block_rows=3)) == wanted


def plain_plan(counts, shards):
    """Rows one by one: home first, then on clockwise."""
    nodes = ring_sharding.ring(shards, 8, 64)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    taken, placed, left = Counter(), {}, []
    for key in sorted(counts):
        order = ring_sharding.clockwise(nodes, key[0])
        for i in range(counts[key]):
            if taken[order[0]] < room[order[0]]:
                placed[(*key, i)] = (order[0], taken[order[0]])
                taken[order[0]] += 1
            else:
                left.append(((*key, i), order))
    for row, order in left:
        shard = next(s for s in order if taken[s] < room[s])
        placed[row] = (shard, taken[shard])
        taken[shard] += 1
    return placed


def test_ring_plan_like_row_by_row():
    chance = random.Random(9)
    for shards in (1, 3, 7):
        counts = {(chance.randrange(64), chance.randrange(3)): chance.randrange(1, 30) for _ in range(40)}
        made = {}
        for cell, spread, start, end, shard, slot in ring_sharding.plan(counts, shards, 8, 64):
            made |= {(cell, spread, i): (shard, slot + i - start) for i in range(start, end)}
        assert made == plain_plan(counts, shards)


def test_sharding_edges(llm_spark, documents):
    rows = [(1, None), (2, ""), (2, "é"), (None, "x")] + [(7, "same")] * 200
    got = ring_sharding.assign(documents(rows), shards=5).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(counts[shard]))
    sizes = Counter((r["size"], r["text_crc32"]) for r in got)
    assert sizes[(8, 0)] == 2 and sizes[(10, zlib.crc32("é".encode()))] == 1
    assert ring_sharding.assign(documents([])).count() == 0


def test_most_rows_stay_when_a_shard_comes(llm_spark):
    counts = {(c, 0): 100 for c in range(ring_sharding.CELLS)}
    home = lambda shards: {(p[0], i): p[4] for p in ring_sharding.plan(counts, shards) for i in range(p[2], p[3])}
    before, after = home(24), home(25)
    assert sum(before[k] != after[k] for k in before) < 0.35 * len(before)


def test_rows_of_one_id_and_set_keep_the_same_row_in_any_order(llm_spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, f"s{i}", i) for i in (3, 1, 2)] + [(5, text.replace(" ", "  "), "s0", 9), (8, text, "s0", 0), (None, text, "s7", 1), (6, None, "s8", 2)]
    schema = "doc_id long, text string, source string, _place int"
    for order in (rows, rows[::-1]):
        kept = chosen_path.keep_one(llm_spark.createDataFrame(order, schema).repartition(3))
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(5, text.replace(" ", "  "), "s0", 9), (None, text, "s7", 1), (6, None, "s8", 2)], key=repr)
