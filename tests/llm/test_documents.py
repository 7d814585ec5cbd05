import functools
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codequarry.llm import exact_dedup, licence_scan, mixing, ngram_join, packing, token_files, tokens, toxicity

RUN = re.compile("[\x20\x09-\x0d]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@functools.cache
def library(name):
    return Tokenizer.from_file(tokens.tokenizer_path(name))


def ids(name, text):
    return np.array([*library(name).encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_exact_dedup_agrees_with_brute_force(awkward):
    texts = [(r["doc_id"], RUN.sub(" ", r["text"] or "")) for r in rows_of(awkward.select("doc_id", "text"))]
    out = rows_of(exact_dedup.exact_dedup(awkward))
    assert len(out) == len(texts)
    for r in out:
        text = next(t for i, t in texts if i == r["doc_id"])
        same = [i for i, t in texts if t == text]
        known = [i for i in same if i is not None]
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["group_size"], r["keep_id"]) == (len(same), min(known) if known else None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_dedup_keeps_columns_and_takes_empty_tables(awkward, nothing):
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in rows_of(kept.select("doc_id"))) == [0, 1, 4, 6, 7, 8, 9, 10, 11, 12, 13]
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0


def test_a_full_filter_only_costs_time(awkward, monkeypatch):
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 1 << 15)
    many = awkward.sparkSession.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 15_000).cast("string").alias("text"))
    out = exact_dedup.exact_dedup(many)
    assert out.where("kept").count() == 15_000 and out.where("group_size = 2").count() == 10_000


def test_toxicity_learns_and_takes_awkward_rows(spark, awkward, nothing):
    texts = [(k, f"{'you are a zonk person' if k % 3 == 0 else 'you are a fine person'} number {k}.", k % 3 == 0) for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in texts] + [(1, None), (None, 1)], "doc_id long, toxic int")
    grammar = toxicity.learn(docs, labels)
    assert "zonk" in grammar.words
    out = rows_of(docs.select("doc_id", toxicity.score_of(docs, grammar).alias("score"), toxicity.held_out(F.col("doc_id")).alias("h")))
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in out)
    assert {r["doc_id"] for r in out if r["h"]} == {k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0}
    scored = rows_of(awkward.withColumn("score", toxicity.score_of(awkward, grammar)))
    assert len(scored) == 15 and all(0 <= r["score"] < 0.5 for r in scored)
    assert nothing.withColumn("score", toxicity.score_of(nothing, grammar)).count() == 0
    assert toxicity.learn(docs, labels.where("false")).words == {}


def test_grammar_composes_its_transducers():
    g = toxicity.Grammar(words={"idiot": 4.0}, beginnings={"mord": 4.0})
    plain = g.clause("an idiot".split())
    assert g.clause("you idiot".split()) > plain > g.clause("not an idiot".split()) > 0
    assert g.clause("he said an idiot".split()) < g.clause("he is an idiot".split())
    assert g.clause("i will hurt you".split()) > 0 == g.clause("i will help you".split())
    assert g.clause(["mordling"]) == g.clause(["idiot"])
    assert toxicity.Scanner(g).features("A fine day. You idiot! Bye.")[0] == g.clause(["you", "idiot"])


def test_licence_scan_agrees_with_brute_force(awkward, nothing):
    out = {r["doc_id"]: r for r in rows_of(licence_scan.scan(awkward, ["doc_id"]))}
    for d, text in {(r["doc_id"], r["text"]) for r in rows_of(awkward.select("doc_id", "text"))}:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = sorted((k, label) for p, label in licence_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        r = out[d]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
    assert licence_scan.scan(nothing, ["doc_id"]).count() == 0


def test_licence_chains_bridge_small_gaps():
    s = licence_scan.Scanner()
    notice = dict(licence_scan.TEMPLATES)["bsd"]
    words = notice.split()
    broken = " ".join(words[:9] + ["oddly"] + words[10:])
    assert "bsd" in s.scan(broken).labels()[1] and s.scan(" ".join(words[:4])).labels()[1] == ""


def test_packing_places_each_token_once(awkward, nothing):
    out = packing.pack(awkward, tokens.tokenizer_path("word_bpe_49k.json")).toPandas()
    texts = awkward.select("doc_id", "text").toPandas()
    assert out["length"].sum() == sum(len(ids("word_bpe_49k.json", t if isinstance(t, str) else "")) for t in texts["text"])
    long = ids("word_bpe_49k.json", texts["text"][7])
    own = out[out["doc_id"] == 7].sort_values("start")
    assert [zlib.crc32(long[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"], strict=True)] == own["ids_crc32"].tolist()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= packing.LENGTH
    assert packing.pack(nothing, tokens.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_column_generation_beats_or_meets_first_fit():
    rng = np.random.default_rng(5)
    sizes = np.arange(1, 513)
    demand = np.bincount(np.clip(rng.lognormal(4.2, 0.8, 20_000).astype(int), 1, 512), minlength=513)[1:]
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    found = packing.plan(sizes, demand)
    held = np.zeros(len(sizes), int)
    for pattern, uses in found:
        assert sum(sizes[k] * n for k, n in pattern.items()) <= 512
        for k, n in pattern.items():
            held[k] += n * uses
    assert (held >= demand).all()
    assert sum(u for _, u in found) <= 1.01 * np.ceil((sizes * demand).sum() / 512) + 5


def test_knapsack_is_exact():
    value, counts = packing.knapsack(np.array([3.0, 4.0, 7.5]), np.array([2, 3, 5]), 11)
    best = max(3 * a + 4 * b + 7.5 * c for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= 11)
    assert value == best and counts @ np.array([3.0, 4.0, 7.5]) == best


def sets_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components_of(docs):
    parent = list(range(len(docs)))
    sets = [sets_of(t) for _, t in docs]
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                old, new = parent[a], parent[b]
                parent = [new if p == old else p for p in parent]
    return [min(docs[j][0] for j in range(len(docs)) if parent[j] == parent[k]) for k in range(len(docs))]


def test_near_duplicates_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3_000)]
    passage = list(rng.choice(words, 60))
    docs = []
    for g in range(25):
        text = list(rng.choice(words, int(rng.integers(3, 500))))
        if g % 2:
            text += passage
        for _ in range(int(rng.integers(1, 6))):
            copy = list(text)
            for _ in range(int(rng.integers(0, max(2, len(copy) // 25)))):
                copy[rng.integers(len(copy))] = "changed"
            docs.append((len(docs), " ".join(copy)))
    out = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["component_id"] for r in out] == components_of(docs)
    assert [r["n_shingles"] for r in out] == [len(sets_of(t)) for _, t in docs]


def test_near_duplicates_link_sets_across_the_bound_of_whole_ones(spark):
    docs = []
    for g in range(91):
        small = 90 + g  # shingles; below 97 all are posted, above 128 a part
        text = [f"g{g}w{k}" for k in range(small * 4 // 3 + 4)]  # similarity 0.75, or just above
        docs += [(2 * g, " ".join(text[: small + 4])), (2 * g + 1, " ".join(text))]
    out = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    want = components_of(docs)
    assert [r["component_id"] for r in out] == want == [d - d % 2 for d, _ in docs]


def test_near_duplicates_take_awkward_rows(awkward, nothing):
    out = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(awkward).collect()}
    by_id = {d: c for d, _, c in out}
    assert by_id[3] == by_id[2] == by_id[1] == 1 and by_id[9] == 1 and by_id[11] == by_id[10] == 10
    assert {n for d, n, _ in out if d in (4, 5, 6)} == {0} and all(by_id[d] == d for d in (4, 5, 6))
    assert by_id[None] is None
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_ngram_join_takes_all_texts_of_a_repeated_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    docs = [(1, a), (1, b), (2, f"{a} more"), (3, f"{b} more"), (3, f"{b} more"), (4, "c d e f g h"), (None, a)]
    out = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}
    assert out.count() == len(docs)


def test_ngram_join_agrees_with_brute_force_where_ids_repeat(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(25):
        words = [f"w{x}" for x in rng.integers(0, 5000, 70)]
        texts += [" ".join(words), " ".join(words[: int(rng.integers(50, 70))]), " ".join([*words[:-1], "x"])]
    docs = [(int(i), t) for i, t in zip(rng.integers(0, 40, len(texts)), texts, strict=True)]
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in docs]
    component = {i: i for i, _ in docs}
    for x in range(len(docs)):
        for y in range(x):
            both = len(shingles[x] & shingles[y])
            if 100 * both >= 75 * len(shingles[x] | shingles[y]):
                u, v = component[docs[x][0]], component[docs[y][0]]
                component = {i: min(u, v) if c in (u, v) else c for i, c in component.items()}
    out = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == sorted((i, component[i]) for i, _ in docs)


@pytest.mark.parametrize("split", [None, 40])
def test_signature_tree_finds_all_links(split):
    rng = np.random.default_rng(7)
    base = [np.unique(rng.integers(0, 1 << 60, int(rng.integers(20, 400)), dtype=np.uint64)) for _ in range(20)]
    sets = []
    for k in range(90):
        s = base[k % 20]
        sets.append(np.unique(np.concatenate([s[rng.random(len(s)) > 0.08], rng.integers(0, 1 << 60, 3, dtype=np.uint64)])))
    got = dict(ngram_join.forest(list(range(90)), sets, split))
    parent = list(range(90))
    for a in range(90):
        for b in range(a):
            if (split is None or (a < split) != (b < split)) and ngram_join.linked(sets[a], sets[b]):
                old, new = parent[a], parent[b]
                parent = [new if p == old else p for p in parent]
    least = {p: min(k for k in range(90) if parent[k] == p) for p in parent}
    assert [got.get(k, k) for k in range(90)] == [least[p] for p in parent]


@pytest.mark.parametrize(("name", "bound"), [("BLOCK_ROWS", 16), ("BLOCK_SHINGLES", 1_000)])
def test_large_blocks_are_dealt_into_parts(spark, monkeypatch, name, bound):
    monkeypatch.setattr(ngram_join, name, bound)
    base = [f"w{k}" for k in range(120)]
    docs = [(k, " ".join(["x" if j == k % 100 else w for j, w in enumerate(base)])) for k in range(100)]
    out = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["component_id"] for r in out.collect()} == {0}


def test_mixing_reaches_its_targets(spark, awkward, nothing):
    docs = spark.createDataFrame([(k, " ".join(["w"] * (k % 300)), f"s{k % 7}" if k % 11 else None) for k in range(3_000)], "doc_id long, text string, source string")
    out = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(3)).toPandas()
    assert out.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert (out["taken"] <= 2 * out["size"]).all()
    source = {k: f"s{k % 7}" if k % 11 else "" for k in range(3_000)}
    for _, g in out.groupby(out["doc_id"].map(source)):
        assert g["size"].sum() == g["source_size"].iloc[0] and abs(g["taken"].sum() - g["target"].iloc[0]) <= 3 * mixing.BLOCK
    small = mixing.mix(awkward).toPandas()
    assert len(small) == 15 and (small["taken"] <= 2 * small["size"]).all()
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    mixed = mixing.mixed(awkward)
    assert mixed.columns == awkward.columns
    once = small.drop_duplicates(["doc_id", "size"]).set_index("doc_id")["taken"]
    got = mixed.where("doc_id <> 2").groupBy("doc_id").agg(F.sum(mixing.words_in(F.col("text"))).alias("n")).toPandas().set_index("doc_id")["n"]
    assert all(once[d] == got.get(d, 0) for d in once.index if d == d and d != 2)


def test_sainte_lague_by_hand():
    votes = np.array([53_000, 24_000, 23_000])
    assert mixing.sainte_lague(votes, 7, np.full(3, 7)).tolist() == [3, 2, 2]
    assert mixing.sainte_lague(votes, 7, np.array([1, 7, 7])).tolist() == [1, 3, 3]
    assert mixing.sainte_lague(np.array([1, 1, 1]), 2, np.full(3, 9)).sum() == 2
    assert np.allclose(mixing.targets([100, 100, 100]), [200, 250 / 3, 500 / 3])


def test_token_files_round_trip(awkward, nothing):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    out = token_files.read_tokens(token_files.write_tokens(awkward, path, lead=True)).orderBy("start").collect()
    texts = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in awkward.select("doc_id", "text").collect()))
    want = [ids("byte_bpe_50k.json", t) for _, t in texts]
    assert [r["ids_crc32"] for r in out] == [zlib.crc32(w.tobytes()) for w in want]
    assert [r["start"] for r in out] == np.concatenate(([0], np.cumsum([len(w) for w in want])[:-1])).tolist()
    assert [r["doc_id"] for r in out] == [None if d == -1 else d for d, _ in texts]
    assert token_files.read_tokens(token_files.write_tokens(nothing, path, lead=True)).count() == 0


def test_directly_addressable_codes():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 256, 3_000), rng.integers(0, 1 << 16, 3_000), rng.integers(0, 1 << 32, 500), [0, 255, 256, (1 << 32) - 1]]).astype(np.uint32)
    rng.shuffle(values)
    s = token_files.Segment(token_files.pack_segment(np.array([4, 9]), np.array([2_000, len(values) - 2_000]), values))
    assert (s.all() == values).all() and [s.token(k) for k in range(0, len(values), 37)] == values[::37].tolist()
    assert s.starts.tolist() == [0, 2_000, len(values)] and s.doc_ids.tolist() == [4, 9]


def test_pieces_encode_as_whole_texts():
    rng = np.random.default_rng(2)
    letters = list("ab  \n\t\u00a0'sS.,1́é\x1c\x85")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 25)))) for _ in range(1_500)]
    texts += ["a <|endoftext|> b", "word.<|startoftext|>,", "Éa. ÜBER, straße! ßa) École", "x's y'd. İs ΣΑΣ", " ", ""]
    for name, lead in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        got = tokens.PieceEncoder(tokens.tokenizer_path(name), lead).encode(texts)
        assert got == [ids(name, t)[:-1].tobytes() for t in texts]


def test_toxicity_on_held_out_documents(spark):
    """Learnt on labelled documents that aren't held out, right on the others by their labels."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    rows = toxicity.op1_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    found = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert len(found) > 50 and sum(found) >= 0.9 * len(found)
    assert len(clean) > 500 and sum(clean) <= 0.01 * len(clean)


def test_words_side_by_side_and_over_a_line_break_keep_their_ids():
    """New words are one sequence for the model, and words over a line break don't take the whole path."""
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    enc = tokens.PieceEncoder(path, True)
    assert enc.wall is not None and tokens.PieceEncoder(tokens.tokenizer_path("word_bpe_49k.json"), False).wall is None
    rng = np.random.default_rng(5)
    letters = list("aeiounrstlzqXYÀéñöÿ")
    word = lambda: "".join(rng.choice(letters, rng.integers(1, 14)))
    mark = lambda: str(rng.choice(["", ".", ",", "!?", '")', "*&"]))
    between = lambda: str(rng.choice([" ", " ", " ", "\n", "\n\n", "\r\n", "\n\t"]))
    texts = ["".join(word() + mark() + between() for _ in range(200)) for _ in range(20)] + ["a.\nb c'\nd e.\n'll f\n g.\nh \n"]
    got = enc.encode(texts)
    assert got == [ids("byte_bpe_50k.json", t)[:-1].tobytes() for t in texts]
    seen = []
    whole = enc.whole
    enc.whole = lambda pieces: seen.extend(pieces) or whole(pieces)
    enc.encode(["one Qoneword.\nQtwoword, more"])
    assert not any("Qtwoword" in p for p in seen)
