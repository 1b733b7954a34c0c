"""Token files, vector codes and the prefix trie against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from dialoom.llm import packing, prefix_trie, token_counts, token_files, vector_codes

PATH = P.path("word_bpe_49k.json")
TEXTS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
TALK = "conv_id long, turn long, role string, text string"


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- op11


def encoded_by_library(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID], "<u4")) for i, t in rows]


def brute_documents(rows):
    out, start = [], 0
    for i, ids in encoded_by_library(rows):
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def odd_texts():
    rng = random.Random(5)
    rows = [(None, "no id"), (1, ""), (2, None), (3, "x y " * 20_000), (5, "A man, a plan!! 12 <|endoftext|> it's"), (6, "  "), (9, "é 中文 words")]
    return rows + [(10 + i, " ".join(rng.choice(["alpha", "beta", "gammas", "12", "delta?"]) for _ in range(rng.randrange(60)))) for i in range(200)]


@pytest.mark.parametrize("shard", [500, 1 << 22])
def test_token_files_read_back_as_the_library_encodes(spark, shard):
    rows = odd_texts()
    docs = spark.createDataFrame([(i, t, "extra") for i, t in reversed(rows)], TEXTS + ", start string")
    files = token_files.write_tokens(docs, PATH, shard_tokens=shard)
    assert shown(token_files.read_documents(files)) == brute_documents(rows)
    assert files.count() > 10 if shard == 500 else files.count() <= 8


def test_token_files_count_find_and_access(spark):
    rows = odd_texts()
    files = token_files.write_tokens(spark.createDataFrame(rows, TEXTS), PATH, shard_tokens=2_000)
    each = encoded_by_library(rows)
    flat = np.concatenate([ids for _, ids in each])
    tokens = sorted({int(flat[0]), 2, 49407, 11, int(flat[500])})
    assert {r.token: r.n for r in token_files.count_tokens(files, tokens).collect()} == {t: int((flat == t).sum()) for t in tokens}
    assert shown(token_files.find_tokens(files, tokens)) == sorted(((t, i, int(at)) for t in tokens for i, ids in each for at in np.flatnonzero(ids == t)), key=str)
    asked = [0, 7, 7, len(flat) - 1, len(flat), -1, None, *range(100, 9_000, 371)]
    found = token_files.tokens_at(files, spark.createDataFrame([(x,) for x in asked], "place long"))
    assert shown(found) == sorted(((x, int(flat[x]) if x is not None and 0 <= x < len(flat) else None) for x in asked), key=str)


def test_token_files_of_repeated_rows_and_none(spark):
    rows = [(4, "same text"), (4, "same text"), (4, "other words here"), (8, "end")]
    found = shown(token_files.read_documents(token_files.write_tokens(spark.createDataFrame(rows, TEXTS), PATH)))
    assert [r[0] for r in sorted(found, key=lambda r: r[1])] == [4, 4, 4, 8]
    assert sorted(r[2:] for r in found) == sorted(r[2:] for r in brute_documents(rows))
    assert sorted(r[1] for r in found) == list(np.cumsum([0, *[r[2] for r in sorted(found, key=lambda r: r[1])]])[:-1])
    none = token_files.write_tokens(spark.createDataFrame([], TEXTS), PATH)
    assert none.count() == 0 and token_files.read_documents(none).count() == 0
    assert shown(token_files.count_tokens(none, [7])) == [(7, 0)] and token_files.find_tokens(none, [7]).count() == 0
    assert shown(token_files.tokens_at(none, spark.createDataFrame([(0,)], "place long"))) == [(0, None)]


def test_known_words_are_looked_up_once():
    """A word that a worker holds costs one look, and no list of words is made value by value."""

    class Counted(dict):
        looks = 0

        def get(self, *a):
            Counted.looks += 1
            return super().get(*a)

        def __getitem__(self, k):
            Counted.looks += 1
            return super().__getitem__(k)

        def __contains__(self, k):
            Counted.looks += 1
            return super().__contains__(k)

    encoder, texts = packing.WordEncoder(PATH), [" ".join(t for _, t in odd_texts() if t and "<|" not in t), "", None, "12 it's é, new"]
    encoder.encode(pa.array(texts[1:]))
    encoder.slot = Counted(encoder.slot)
    for known in (False, True):
        Counted.looks, before = 0, len(encoder.slot)
        ids, starts = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [x.tolist()[:-1] for _, x in encoded_by_library(enumerate(texts))]
        assert Counted.looks == len(encoder.slot) + len(encoder.slot) - before and (len(encoder.slot) == before) == known
    words = pa.array([f"word {i}" for i in range(100_000)])
    began = time.process_time()
    slow, middle = words.to_pylist(), time.process_time()
    assert packing.strings(words) == slow and time.process_time() - middle < (middle - began) / 2


def test_ascii_runs_go_to_the_bare_model():
    """Every ASCII character, capitals and other scripts: ids are the library's, and its normalizer and pattern of words see no
    ASCII run."""

    class Seen:
        def __init__(self, inner):
            self.inner, self.texts = inner, []

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **more):
            self.texts += texts
            return self.inner.encode_batch_fast(texts, **more)

    rng = random.Random(3)
    printed = [chr(i) for i in range(33, 127)]
    texts = [" ".join("".join(rng.choices(printed, k=rng.randrange(1, 9))) for _ in range(300)) for _ in range(5)]
    texts += ["Straße İstanbul ÉTÉ naïve don't DON'T we'll ﬁne e\u0301te Ωmega привет, мир! 中文。 x² a\u00a0b", " ".join("plain words <| | > only, (here) [and] there...".split())]
    encoder = packing.WordEncoder(PATH)
    encoder.tokenizer = Seen(encoder.tokenizer)
    ids, starts = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [x.tolist()[:-1] for _, x in encoded_by_library(enumerate(texts))]
    runs = [r for t in encoder.tokenizer.texts for r in t.split()]
    assert runs and not [r for r in runs if r.isascii() and not re.search(r"[\d']", r)]


@pytest.mark.parametrize("symbols", [1, 2, 3, 200, 70_000])
def test_wavelet_matrix_by_itself(symbols):
    """Every kind of question of one file of several blocks, against arrays; ids above 16 bits too."""
    rng = np.random.default_rng(symbols)
    ids = np.minimum(rng.geometric(min(0.9, 20 / symbols), 150_000) - 1, symbols - 1).astype(np.uint32) * np.uint32(3)
    ids[rng.integers(0, len(ids), 50)] = rng.integers(0, symbols, 50) * 3
    lengths = np.array([100_000, 1, 49_999])
    file = token_files.TokenFile(pa.BufferReader(token_files.build(ids, pa.array([5, None, 9]), lengths)))
    assert (file.everything() == ids).all() and file.doc_ids.to_pylist() == [5, None, 9] and (file.document(2) == ids[100_001:]).all()
    at = rng.integers(0, len(ids), 300)
    assert (file.tokens(at) == ids[at]).all()
    for token in [int(x) for x in {*rng.choice(ids, 4).tolist(), 1}]:
        assert file.count(token) == (ids == token).sum() and file.count(token, 70_000, 131_073) == (ids[70_000:131_073] == token).sum()
        assert (file.occurrences(token) == np.flatnonzero(ids == token)).all()
        assert (file.occurrences(token, 65_000, 66_000) == 65_000 + np.flatnonzero(ids[65_000:66_000] == token)).all()


def test_wavelet_file_reads_few_blocks():
    ids = np.random.default_rng(1).integers(0, 40_000, 1 << 20).astype(np.uint32)
    blob = token_files.build(ids, pa.array([1]), np.array([len(ids)]))
    file = token_files.TokenFile(pa.BufferReader(blob))
    assert file.tokens(np.array([123_456]))[0] == ids[123_456] and len(file.held) == file.levels
    assert len(blob) < 2.2 * len(ids)
    with pytest.raises(ValueError):
        token_files.TokenFile(pa.BufferReader(b"something else" * 9))


# ---- op12


def brute_codes(rows):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max([1, *(len(v) for _, v, _ in kept)]) // 4) * 4
    x = np.array([v + [0] * (width - len(v)) for _, v, _ in kept], dtype=np.int64)
    size = width // 4
    books = [x[:256, k * size : (k + 1) * size].copy() for k in range(4)]

    def assign():
        apart = [((x[:, None, k * size : (k + 1) * size] - books[k]) ** 2).sum(2) for k in range(4)]
        return [d.argmin(1) for d in apart], sum(d.min(1) for d in apart)

    for _ in range(4):
        for k, c in enumerate(assign()[0]):
            for e in set(c.tolist()):
                books[k][e] = x[c == e, k * size : (k + 1) * size].sum(0) // (c == e).sum()
    code, error = assign()
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    labels = defaultdict(int)
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        labels[label] += e
    return sorted(((i, "".join(f"{c[j]:02x}" for c in code), int(error[j]), labels[label], digest) for j, (i, _, label) in enumerate(kept)), key=str)


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * rng.choice([1, 1, 900])], int(i % 5) if i % 7 else None) for i in range(700)]
    rows += [(1, None, 2), (2, [math.nan] * 8, 1), (3, [1.0, None], 1), (4, [], 1), (5, [1.0, 2.0, 3.0], 3), (None, [1.0] * 8, None), (5, [1.0, 2.0, 3.0], 3), (9, [math.inf] * 8, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", code string")
    assert shown(vector_codes.vector_codes(df)) == brute_codes(rows)


def test_vector_codes_of_few_equal_and_no_vectors(spark):
    same = [(i % 3, [0.25, -0.5, 1.0, 3.0], None) for i in range(9)]
    assert shown(vector_codes.vector_codes(spark.createDataFrame(same, VECTORS))) == brute_codes(same)
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    far = [(1, [1e30, 0.0, 0.0, 0.0], 1), (2, [-1e30, 0.0, 0.0, 0.0], 1)]
    assert [r[1] for r in shown(vector_codes.vector_codes(spark.createDataFrame(far, VECTORS)))] == ["00000000", "01000000"]


@pytest.mark.parametrize("scale", [8, 30_000_000])
def test_exponion_search_is_exact(scale):
    """Also with equal entries and equal distances, from any start, in doubles and beyond them; near starts read few entries."""
    rng = np.random.default_rng(scale)
    x, entries = rng.integers(-scale, scale, (900, 3)), rng.integers(-scale, scale, (120, 3))
    entries[7] = entries[90]
    apart = ((x[:, None] - entries) ** 2).sum(2)
    book = vector_codes.Codebook(entries)
    for start in (np.zeros(900, np.int64), rng.integers(0, 120, 900), apart.argmin(1)):
        best, low = book.nearest(x, start)
        assert (best == apart.argmin(1)).all() and (low == apart.min(1)).all()
    reach = [np.searchsorted(book.near[s], 4 * d, side="right") for s, d in zip(apart.argmin(1), apart.min(1), strict=True)]
    assert np.mean(reach) < 60


# ---- op13


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], (r, x)))
    own = {c: [z[2] for z in sorted(v)] for c, v in own.items()}
    seqs, members, kids = {}, defaultdict(list), defaultdict(set)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = (*own.get(c - int(math.fmod(c, 20)), [])[:h], *v[h:])
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        worth = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += worth
            leaves[p[:d]] += p not in kids
    digest = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), leaves[p], saved[p], digest(p, m)) for p, m in members.items()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_prefix_trie_equals_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    for c in range(240):
        if rng.random() > 0.2:
            sign = rng.choice([1, 1, 1, -1])
            rows += [(c * sign, t if rng.random() > 0.05 else None, rng.choice(["u", "a", None]), rng.choice(["x y", "z", None, "", "q  r\ts"])) for t in range(rng.choice([1, 2, 3, 4, 7]))]
    rows += [(None, 0, "u", "x")] * 3 + rows[:9] + [(20 * k, t, "u", "x y") for k in range(60) for t in range(k % 5)]
    df = spark.createDataFrame([(*r, 1) for r in rows], TALK + ", depth int").repartition(7)
    assert shown(prefix_trie.prefix_trie(df)) == brute_trie(rows)


def test_prefix_trie_of_hot_turns_over_many_shards(spark):
    """A first turn of nearly all conversations, one conversation of a third of them, long chains of prefixes."""
    rows = [(c, t, "u", "hello there all") for c in range(300) for t in range(1)] + [(c, t, "a", f"same {t}") for c in range(0, 300, 3) for t in range(1, 5)]
    rows += [(c, t, "a", f"own words of {c % 40} at {t}") for c in range(1, 300, 3) for t in range(1, 4)] + [(5_000 + c, t, "s", "again and again") for c in range(50) for t in range(c)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        assert shown(prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK))) == brute_trie(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_prefix_trie_of_nothing_and_a_long_text(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], TALK)).count() == 0
    rows = [(40, 0, "u", "word " * 200_000), (41, 0, "u", "word " * 200_000), (41, 1, None, None), (60, 0, "u", "")]
    assert shown(prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK))) == brute_trie(rows)


# ---- the table of frequent pre-tokens of op10


def test_frequent_pieces_are_counted_over_all_tasks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, weights=range(1, 401), k=200)) for _ in range(150)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(40)
    found = token_counts.frequent_pieces(docs).to_pylist()
    counts = defaultdict(int)
    for t in texts:
        for i, w in enumerate(t.split(" ")):
            counts[" " * (i > 0) + w] += 1
    assert [p for p in found if p] == sorted(counts, key=lambda p: (-counts[p], p))
    assert len(token_counts.frequent_pieces(docs.limit(0))) == 0


def test_bounded_counters_keep_the_heaviest():
    table = pa.table({"piece": ["a", "b", "a", "c", "d"], "n": [1, 5, 3, 4, 4]})
    assert token_counts.heaviest(table, 3).to_pydict() == {"piece": ["b", "a", "c"], "n": [5, 4, 4]}
    lengths = token_counts.Lengths(P.path("byte_bpe_50k.json"), token_counts.hash_table(P.path("byte_bpe_50k.json"), pa.array(["hello", " world", "zq"])))
    assert lengths.of(pa.array([" world", "unknownest", "hello", "zq", ""])).tolist() == token_counts.Lengths(P.path("byte_bpe_50k.json")).encoded([" world", "unknownest", "hello", "zq", ""]).tolist() and "hello" not in lengths.cache
