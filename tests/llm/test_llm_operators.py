"""Each operator against a brute-force version on small fixtures, and its edge cases."""

import collections
import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dialoom.llm import common, decontaminate, html_text, line_dedup, near_dup, packing, secrets, span_dedup, token_counts, toxicity, vector_dedup
from dialoom.llm.common import MemberFilter, components, place

WORD = re.compile(r"[^\W_]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = [f"w{i} {chr(97 + i % 26)}x{i * 7 % 31} of the {i}th kind and no other sort" for i in range(200)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def fixture(spark):
    """Copies, near copies, repeated lines, nulls, empty and long texts, repeated rows, and a few plain texts."""
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(["ba", "bo", "ke", "ti", "lo", "mu", "sa", "re", "ni", "do"], 2).tolist() and ["".join(rng.choice(["ba", "bo", "ke", "ti", "lo", "mu"], 3)) for _ in range(60)]) for _ in range(12)]
    rows = [(i, ". ".join([t[:200], t[200:]]) + ".\nCommon line of boilerplate words here.\n" + t[::-1][:80]) for i, t in enumerate(base)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # copies
    words = rows[0][1].split(" ")
    rows += [(200 + k, " ".join(words[:k] + ["changed"] + words[k + 1 :])) for k in range(3, 40, 6)]  # near copies
    rows += [(300, None), (301, ""), (302, "  \n\n "), (303, "..."), (304, "one"), (305, "one"), (306, " ".join(base) * 20), (7, rows[7][1]), (None, rows[3][1])]
    return table(spark, rows)


# ---- shared helpers


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in range(1, 31)) and all(found[i] == 100 for i in range(100, 140))


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_member_filter_holds_members(spark):
    held = MemberFilter(spark.range(0, 5000, 5))
    every = held.holds([np.arange(5000)])
    assert every[::5].all() and every.mean() < 0.35
    assert len(np.unique(place([np.arange(1000), np.arange(1000)]))) == 1000


# ---- op1


def brute_lines(rows, t=0.8):
    seen, out = [], {}
    for i, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            s = frozenset(WORD.findall(line.lower()))
            dup = bool(s) and any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen)
            if s and s not in seen:
                seen.append(s)
            if not dup:
                kept.append(line)
        out[i] = None if text is None else "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    docs = fixture(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_keeps_columns_nulls_and_empty_tables(spark):
    docs = fixture(spark).withColumn("words", F.lit(1)).withColumn("line_no", F.lit("x"))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id is null").first().text == docs.where("doc_id is null").first().text
    assert out.where("text is not null and n_chars <> length(text)").count() == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# ---- op2


def test_tiles_cover_reordered_passages():
    test, text = np.arange(20, dtype=np.uint64), np.array([99, *range(10, 20), 98, *range(0, 10), 97], np.uint64)
    assert sorted(decontaminate.tiles(test, text, 5)) == [(0, 12, 10), (10, 1, 10)]
    assert decontaminate.tiles(test, np.arange(50, 60, dtype=np.uint64), 5) == []


def test_tiles_prefer_longest_and_do_not_overlap():
    test = np.array([1, 2, 3, 4, 5, 6, 7, 8], np.uint64)
    found = decontaminate.tiles(test, np.array([4, 5, 6, 9, 1, 2, 3, 4, 5, 8, 7, 8, 6, 7, 8], np.uint64), 3)
    assert found[0] == (0, 4, 5) and sum(n for *_, n in found) == 8


def test_decontamination(spark):
    items = spark.createDataFrame([(1, PROSE[1] + " " + PROSE[2]), (2, "too short"), (3, None), (4, "...")], "item_id long, text string")
    a, b = PROSE[1].upper(), PROSE[2].replace(" ", ",  ")
    docs = table(spark, [(1, f"x {b} y z {a} q"), (2, PROSE[5]), (3, "it is Too -- Short, yes"), (4, None), (5, ""), (None, a + " " + b), (6, a), (6, a)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1), (3, 2)}
    assert sorted(r.doc_id for r in decontaminate.without_benchmark(docs, items).where("doc_id is not null").collect()) == [2, 4, 5, 6, 6]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), items).count() == 0


def brute_share(test, text, least):
    """Greedy string tiling by looking at every pair of places in every round."""
    a, b = [False] * len(test), [False] * len(text)
    while True:
        best, found = least, []
        for p in range(len(test)):
            for t in range(len(text)):
                n = 0
                while p + n < len(test) and t + n < len(text) and test[p + n] == text[t + n] and not a[p + n] and not b[t + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((p, t))
        if not found:
            return sum(a) / len(test)
        for p, t in found:
            if not any(a[p : p + best]) and not any(b[t : t + best]):
                a[p : p + best] = b[t : t + best] = [True] * best


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    some = lambda n, words: [f"w{x}" for x in rng.integers(0, words, n)]
    items = [some(n, words) for n, words in ((30, 500), (24, 3), (3, 500), (40, 500), (12, 2), (25, 500))]
    items[3][10:20] = items[0][5:15]  # shared seeds
    texts = []
    for k in range(24):
        own = items[k % 6]
        cut = sorted(rng.integers(0, len(own) + 1, 2))
        parts = [own[: cut[0]], own[cut[0] : cut[1]], own[cut[1] :]]
        rng.shuffle(parts := [" ".join(x) for x in parts])
        texts.append(" ".join([*some(5, 500), parts[0], *some(k % 4, 500), parts[1], *some(40, 2 + k % 3), parts[2]]))
    docs = table(spark, list(enumerate(texts)))
    given = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.coverage, 9) for r in decontaminate.contaminated(docs, given).collect()}
    expected = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            share = brute_share(item, text.split(), min(5, len(item)))
            if share >= 0.6:
                expected[d, i] = round(share, 9)
    assert got == expected and len(expected) > 15


def test_decontamination_of_a_repetitive_long_text(spark):
    items = spark.createDataFrame([(1, " ".join(["a"] * 50)), (2, " ".join(f"x{i}" for i in range(50)))], "item_id long, text string")
    docs = table(spark, [(1, "a " * 1_000_000), (2, "a b " * 500_000), (3, "x1 x2 x3 x4 x5 " * 200_000)])
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 1)}


# ---- op3


def test_malformed_pages_lose_no_text_and_take_no_square_time():
    tree = html_text.train()
    page = f"<article><h1>Head</h1><p title=it's>First {html_text.PROSE}</p><p data-x='a>b' class=\"c>d\">isn't {html_text.PROSE}</p></article>"
    assert html_text.main_text(page, tree).startswith("Head\n\nFirst The") and "\n\nisn't The" in html_text.main_text(page, tree)
    began = time.time()
    for part in ("<a ", "<div>", "</ul>", '<a x=">"', "<script ", "<!", "<!-- ", "<a href='", "<", '<div class="a">x'):
        html_text.main_text(part * (1_000_000 // len(part)), tree)
    html_text.main_text("<div>" * 100_000 + "</ul>" * 100_000, tree)
    assert time.time() - began < 20


#: Pages that the tree isn't trained on: (markup, label) in order, in other words and layouts than the labelled table.
FRESH = (
    (("<div id=masthead><span>Harbour Gazette</span></div>", 0), ("<nav><a href=/w>Weather</a> <a href=/s>Sport</a></nav>", 0), ("<main><h1>Ferry returns to service</h1>", 1), ("<p>After eleven weeks in dry dock the island ferry carried its first passengers on Friday morning, to the relief of commuters.", 1), ("<p>Tickets cost what they did before.", 1), ("<p>The operator said that both engines had been replaced and that no further stops were planned before the autumn.</main>", 1), ("<div class='related-links'><a href=/1>Ferry history</a> <a href=/2>Timetable</a></div>", 0), ("<footer>Harbour Gazette, Pier Street 4</footer>", 0)),
    (("<ul id=nav><li><a href=/a>Recipes</a></ul>", 0), ("<article><h2>Lentil soup for six</h2>", 1), ("<p>Rinse the lentils, cover them with cold water and let them stand while you chop the onions, carrots and celery.", 1), ("<ol><li>Fry the vegetables gently.", 1), ("<li>Add stock and simmer for forty minutes.</ol>", 1), ("<p>Serve with bread.</article>", 1), ("<section class=comments><p>I tried this with red lentils and it was done in half the time, so keep an eye on it.</section>", 0), ("<form><label>Email</label>", 0), ("<button>Subscribe</button></form>", 0)),
    (("<div class='ad-slot'>Save on winter tyres this week only at all our branches.</div>", 0), ("<div class=post><h1>Why the lake is green</h1>", 1), ("<p>Warm water, little wind and a great deal of fertiliser from the fields around it have let algae spread over the whole lake.", 1), ("<p>They will be gone by October.", 1), ("<p>Until then the town advises bathers to stay out, and dog owners to keep their animals on the lead near the shore.</div>", 1), ("<aside>Most read this month in our science pages and elsewhere.</aside>", 0), ("<p><a href=/p>Imprint</a> <a href=/q>Data protection</a></p>", 0)),
)


def test_tree_on_pages_it_is_not_trained_on():
    tree, right, total = html_text.train(), 0, 0
    for page in FRESH:
        found = html_text.blocks("".join(p for p, _ in page))
        labels = [y for _, y in page]
        assert len(found) >= len(labels) - 2
        text = html_text.main_text("".join(p for p, _ in page), tree)
        for part, y in page:
            words = re.sub(r"<[^>]*>", " ", part).split()
            right += (" ".join(words[:6]) in text) == bool(y)
            total += 1
    assert right / total >= 0.95


def test_html_blocks_and_text(spark):
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=x>Home</a></nav><div class='sidebar'>Read more of our long list of very fine stories today</div><article><h1>Head &amp; tail</h1><p><b>First&nbsp;block<br>goes  on<p>Short.<div class=\"comments\"><p>I like it very much, thanks for writing all of this.</div></article><footer>&copy; us</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>unclosed <b"), (None, "u", "just text " * 30), (1, "u", page)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert got[0].text == "Head & tail\n\nFirst block goes on\n\nShort." and got[0].n_chars == len(got[0].text)
    assert [r.text for r in got[1:3]] == ["", ""] and got[5] == got[0]


def test_tree_fits_its_table():
    tree = html_text.train()
    right = total = 0
    for page in html_text.LABELLED:
        found = html_text.blocks("".join(p for p, _ in page))
        right += sum(html_text.is_main(tree, x) == bool(y) for x, (_, y) in zip(html_text.features(found), page, strict=True))
        total += len(page)
    assert right / total > 0.95


def test_words_of_texts_and_lines(monkeypatch):
    texts = pa.array([None, "", "a\n", "\n\nb", "Éa b ça x̀ Ünï\nfoo", "ab", "cd", "a" * 90 + " b", "ÀB àb 12٣ 中文。字", "x" * 70 + "_y"])
    monkeypatch.setattr(common, "CHUNK", 16)
    hashes, starts = common.word_hashes(texts)
    words, begins = common.word_lists(texts)
    assert (starts == begins).all()
    both = set(zip(hashes.tolist(), words.to_pylist(), strict=True))
    assert len(both) == len(set(hashes.tolist())) == len(set(words.to_pylist()))
    hashed, line, owner, number = common.line_words(texts)
    assert (hashed == hashes).all() and owner.tolist() == [0, 1, 2, 2, 3, 3, 3, 4, 4, 5, 6, 7, 8, 9] and number.tolist() == [0, 0, 0, 1, 0, 1, 2, 0, 1, 0, 0, 0, 0, 0]
    assert line.tolist()[:3] == [2, 6, 7] and (np.diff(line) >= 0).all()


def random_lines(rng, n, words, most):
    return [" ".join(f"w{x}" for x in rng.integers(0, words, rng.integers(1, most))) for _ in range(n)]


@pytest.mark.parametrize("crowd", [False, True])
def test_line_dedup_of_frequent_words_and_crowds(spark, monkeypatch, crowd):
    """Words that are keys in pairs only, and keys whose lines are led, here and in the groups."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(line_dedup, "FREQUENT", 30)
    if crowd:
        monkeypatch.setattr(line_dedup, "LOCAL_CROWD", 4), monkeypatch.setattr(line_dedup, "CROWD", 2), monkeypatch.setattr(line_dedup, "DENSE", 0), monkeypatch.setattr(line_dedup, "GROUP_ROWS", 300)
    lines = random_lines(rng, 300, 40, 14) + random_lines(rng, 60, 4000, 30)
    for k in range(60):  # variants of one line
        own = [f"v{x}" for x in range(20)]
        own[k % 20] = f"u{k}"
        if k % 3 == 0:
            own[(k + 7) % 20] = f"u{k}b"
        lines.append(" ".join(own))
    order = rng.permutation(len(lines))
    rows = [(i // 3, "\n".join(lines[k] for k in order[i : i + 3])) for i in range(0, len(lines), 3)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, rows).repartition(3)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_drops_emptied_documents(spark):
    docs = table(spark, [(1, "one line of words"), (2, "one line of words"), (3, ""), (4, None), (5, "one line of words\nmore"), (6, "...\none line of words"), (None, "one line of words")])
    out = line_dedup.dedup_lines(docs, emptied=False)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "one line of words"), (1, "one line of words"), (3, ""), (4, ""), (5, "more")]


def test_line_dedup_of_more_than_2_to_the_21_lines(spark):
    n = 1 << 21
    text = "first line\n" + "\n" * n + "first line\nlast line"
    got = line_dedup.dedup_lines(table(spark, [(1, text), (2, "last line\nother words")])).collect()
    assert {r.doc_id: r.text for r in got} == {1: "first line\n" + "\n" * n + "last line", 2: "other words"}


# ---- op4


def brute_spans(rows):
    found = collections.defaultdict(list)
    for i, text in rows:
        _, keys, sizes = span_dedup.worded(text or "")
        for k in range(1, span_dedup.SPAN + 1):
            for a in range(len(keys) - k + 1):
                if sum(sizes[a : a + k]) >= (span_dedup.LEAST_WORDS if k == span_dedup.SPAN else span_dedup.LONG_WORDS):
                    found[tuple(keys[a : a + k])].append((i, a, k))
    gone = collections.defaultdict(set)
    for places in found.values():
        for i, a, k in places[1:]:
            gone[i] |= set(range(a, a + k))
    return gone


def test_span_dedup_equals_brute_force(spark):
    docs = fixture(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r.n_removed for r in span_dedup.dedup_spans(docs).collect()}
    gone = brute_spans(rows)
    assert got == {i: len(gone[i]) for i, _ in rows} and sum(got.values()) > 0


def brute_left(rows):
    """Words left of each text, by all passages of all earlier documents."""
    spans, seen, out = brute_spans(rows), {}, {}
    for i, text in rows:
        _, keys, sizes = span_dedup.worded(text)
        words, ends = " ".join(keys).split(" "), np.cumsum([0, *sizes])
        lost, inside = np.zeros(len(words), bool), np.zeros(len(words), bool)
        for a in range(len(words) - 50):
            before = seen.setdefault(tuple(words[a : a + 51]), (i, a))
            lost[a : a + 51] |= before[0] != i
            inside[a : a + 51] |= before != (i, a)
        for p in range(len(keys)):
            if p in spans[i] or inside[ends[p] : ends[p + 1]].all():
                lost[ends[p] : ends[p + 1]] = True
        out[i] = [w for w, g in zip(words, lost, strict=True) if not g]
    return out


def test_span_dedup_finds_passages_with_edges_inside_sentences(spark):
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"q{x}" for x in rng.integers(0, 10**9, n)]

    def stopped(words, sizes):
        ends = set(np.cumsum(sizes) - 1)
        return [w + "." if k in ends else w for k, w in enumerate(words)]

    rows = []
    for i, (length, sizes) in enumerate([(51, (8, 23, 11)), (62, (13, 20, 19)), (51, (25,)), (60, ()), (50, (9, 17, 12)), (155, (1,) * 155), (51, (1, 2) * 17), (90, (30, 31))]):
        passage = stopped(fresh(length), sizes)
        for copy in range(3):
            rows.append((10 * i + copy, " ".join([*fresh(9 + copy), *passage, *fresh(7), "end."]) + "\nLast one " + fresh(1)[0] + "."))
    lines = "\n".join(fresh(30) * 4)
    rows += [(200, lines), (201, lines.upper()), (202, "ja\n" * 120)]
    left = brute_left(rows)
    got = {r.doc_id: r for r in span_dedup.dedup_spans(table(spark, rows).repartition(3)).collect()}
    assert {i: r.text.lower().split() for i, r in got.items()} == left
    assert all((got[i].n_removed > 0) == (len(left[i]) < len(text.split())) for i, text in rows)
    assert len(left[41]) == len(rows[13][1].split()) and all(got[10 * i + 1].n_removed for i in (0, 1, 2, 3, 5, 6, 7))


def test_sentences_rebuild_the_text():
    for text in ("", "a. b! c?\n\nd", 'He said "no." Then left.\n', "no end", " lead. ", "\n\n", "x.y z... w"):
        assert "".join(span_dedup.sentences(text)) == text


def test_sentences_of_a_long_run_of_dots_take_no_square_time():
    began = time.time()
    for text in ("." * 1_000_000, ".)" * 300_000, "a.b" * 300_000):
        assert "".join(span_dedup.sentences(text)) == text
    assert time.time() - began < 10


def test_span_dedup_passes_edge_rows(spark):
    docs = fixture(spark).withColumn("place", F.lit("p"))
    out = span_dedup.dedup_spans(docs)
    assert out.columns == [*docs.columns, "n_removed"] and out.count() == docs.count()
    assert span_dedup.dedup_spans(docs.limit(0)).count() == 0


# ---- op5


def toxic_tables(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("bdgklmnprst"), 2)) + str(k) + "a" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        own = rng.choice(words, 30).tolist()
        if bad := i % 6 == 0:
            own[5], own[12], own[20] = "zorblat", "grumpfen", f"zorbla{i % 4}x"
        rows.append((i, " ".join(own) + "."))
        labels.append((i, 1, int(bad)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = toxic_tables(spark)
    got = toxicity.toxicity(docs.union(table(spark, [(1000, None), (1001, ""), (None, "zorblat")])), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert all(r.predicted == int(r.doc_id % 6 == 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    empty = [r.score for r in got if r.doc_id in (1000, 1001)]
    assert empty[0] == empty[1] < 0.5


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = toxic_tables(spark)
    assert toxicity.toxicity(docs.limit(5), labels.limit(0)).count() == 5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = toxic_tables(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(docs, df).collect())
    assert key(labels) == key(turned)


def test_grammar_contexts():
    g = toxicity.Grammar({"moron": 1.0, "fool": 0.5}, toxicity.PRIOR, toxicity.PRIOR_BIAS)
    kinds = lambda s: "".join(k for k, _ in g.clause(s.split())[0])
    for said, found in {
        "the word moron is old": "p", "what a moron": "P", "moron fool": "pP", "you are such a moron": "a", "moron are you": "pb", "he is not a moron": "n", "she said moron": "r", "she said that you are not a moron": "n",
        "they burn wood": "x", "to burn wood": "w", "i will burn it": "h", "i will kill you": "hy", "you will never burn": "n", "nothing here": "",
    }.items():
        assert kinds(said) == found, said
    machine = toxicity.weighted(g.weights)
    weight = dict(zip(toxicity.TYPES, g.weights, strict=True))
    assert g.clause("moron are you".split(), machine)[1] == pytest.approx(weight["p"] + weight["b"])
    assert g.clause("you fool".split(), machine)[1] == pytest.approx(0.5 * weight["a"])
    assert g.clause("nothing here".split(), machine)[1] == 0


def test_learned_words_of_marks_are_matched():
    g = toxicity.Grammar({"मूर्ख": 1.0, "idio\u0301t": 1.0}, toxicity.PRIOR, toxicity.PRIOR_BIAS)
    assert g.features("वह मूर्ख है").sum() > 0 and g.batch(pa.array(["Idio\u0301t!"])).sum() > 0 and g.batch(pa.array([None, "calm", "a मूर्ख. Calm"])).sum(axis=1).astype(bool).tolist() == [False, False, True]


def test_training_is_repeatable_with_repeated_ids(spark):
    rows = [(i % 40, f"you are a blorp {i % 40}" if i % 2 else f"a calm day {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    one, two = (toxicity.train(table(spark, rows).repartition(n), labels) for n in (2, 5))
    assert one.words == two.words and np.allclose(one.weights, two.weights)


# ---- op6


def test_near_duplicates_equal_brute_force(spark):
    docs = fixture(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r.text for r in docs.collect()}
    bags = {}
    for i, t in rows.items():
        w = WORD.findall((t or "").lower())
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    parent = {i: i for i in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(rows), 2):
        if bags[a] and bags[b]:
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.class_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: (find(i), find(i) == i) for i in rows}
    assert sum(k for _, k in got.values()) < len(rows)


def test_near_duplicates_of_a_chain_in_one_bucket(spark, monkeypatch):
    """Texts that are like their neighbours only: led by any member, most pairs of a bucket are apart."""
    words = [f"x{i}" for i in range(400)]
    rows = [(100 + k, " ".join(words[4 * k : 4 * k + 110])) for k in range(40)]
    monkeypatch.setattr(near_dup, "LEADERS", 2)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(table(spark, rows), bands=200, rows=1).collect()}
    assert set(got.values()) == {100}


def test_near_duplicates_edge_rows(spark):
    docs = fixture(spark).withColumn("band", F.lit(1)).withColumn("id", F.lit(2))
    out = near_dup.near_duplicates(docs)
    assert out.count() == docs.count() and out.where("doc_id is null").first().kept
    assert out.where("doc_id in (300, 301, 302, 303)").where("kept").count() == 4
    kept = near_dup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 7").count() == 2
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)))
    s = near_dup.dart_signatures(np.concatenate((a, b)), np.repeat([0, 1], 400), 2, 1024)
    assert (s[0] == s[1]).mean() == pytest.approx(300 / 500, abs=0.06)


def test_unit_regions_count_repeats():
    regions = near_dup.unit_regions(np.array([5, 5, 9, 5], np.uint64), np.array([0, 0, 0, 1]))
    assert regions[0] == 5 and regions[1] != 5 and regions[3] == 5 and len(set(regions[:3].tolist())) == 3


# ---- op7


def test_secrets_equal_brute_force(spark):
    rows = [(1, None), (2, ""), (3, "token: abc secret=ABCDEFGH1 é " + "ab" * 20), (4, "token:apikey= xyz12345678"), (5, "secret: token: abcdefghij"), (6, "AKIAX AKIA1234567890AB"), (7, "PassWord = 'hunter2hunter2' 😀 api_key:q" + "Z9" * 9), (None, "passwd=12345678"), (3, "x")]
    docs = table(spark, rows).withColumn("hex", F.lit(1))
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))
    expected = []
    for i, t in rows:
        found = []
        for k, (kind, rx) in enumerate(kinds):
            for m in rx.finditer(t or ""):
                if (len(m[2]) >= 8) if kind == "assign" else m.end() - m.start() >= (16 if kind == "access" else 32):
                    found.append((m.start(), k, m.end()))
        shown = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found))
        expected.append((i, *(sum(k == n for _, k, _ in found) for n in range(3)), hashlib.sha256(shown.encode()).hexdigest()))
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert secrets.scan(docs.limit(0)).count() == 0


def test_scan_of_a_text_with_very_many_matches(spark):
    own = [hashlib.md5(str(i).encode()).hexdigest() for i in range(20_000)]
    text = " ".join(f"é{h}" if i % 2 else f"token={h[:12]}" for i, h in enumerate(own))
    began = time.time()
    row = secrets.scan(table(spark, [(1, text)])).first()
    assert (row.n_assign, row.n_hex) == (10_000, 10_000) and time.time() - began < 60
    rx = re.compile(r"token=[0-9a-f]{12}|[0-9a-f]{32}")
    shown = ",".join(f"{'assign' if m[0][0] == 't' else 'hex'}:{m.start()}:{m.end()}" for m in rx.finditer(text))
    assert row.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()


def test_models_score_what_base_spans_leave(spark):
    rest = "kJ8sQ2vXz91LmPq0Rt7WbY3c"
    row = secrets.scan(table(spark, [(1, f"a {rest}/{'ab12' * 8} b")])).first()
    assert row.n_hex == 1 and row.spans == "markov:2:27,hex:27:59"


def test_models_tell_random_from_ordinary(spark):
    docs = table(spark, [(1, "see kJ8sQ2vXz91LmPq0Rt7WbY3c here"), (2, "call get_user_name_from_session_table now"), (3, "internationalization_of_configuration")])
    got = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert got == {1: "markov:4:28", 2: "", 3: ""}


def test_models_on_strings_they_are_not_trained_on(spark):
    """Random strings of another source, and identifiers of words that the models don't know."""
    rng = np.random.default_rng(12)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    secret = ["".join(rng.choice(letters, 32)) for _ in range(200)]
    words = "harbour lantern velvet thunder meadow copper whistle orchard candle bridge winter pepper saddle marble feather anchor blossom canyon timber velour quarry spindle walnut zephyr".split()
    shapes = (lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "".join(x.title() for x in w), lambda w: "_".join(w).upper(), lambda w: "/".join(w))
    plain = [shapes[k % 5](rng.choice(words, 4).tolist()) for k in range(200)]
    got = {r.doc_id: r.spans for r in secrets.scan(table(spark, [(i, f"see {x} here") for i, x in enumerate(secret + plain)])).collect()}
    caught, wrong = sum(bool(got[i]) for i in range(200)), sum(bool(got[200 + i]) for i in range(200))
    assert caught >= 190 and wrong <= 4, (caught, wrong)


def test_scan_runs_no_python_on_rows(spark):
    plan = secrets.scan(table(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- op8


def test_packing_is_an_exact_round_trip(spark):
    docs = fixture(spark)
    path = P.path("word_bpe_49k.json")
    got = packing.pack(docs, path, 128).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    wanted = collections.Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        for at in range(0, len(ids), 128):
            wanted[(r.doc_id, at, zlib.crc32(ids[at : at + 128].tobytes()), len(ids))] += 1
    key = lambda d: None if np.isnan(d) else int(d)
    assert collections.Counter((key(d), s, c, t) for d, s, c, t in zip(got["doc_id"], got["start"], got["ids_crc32"], got["doc_tokens"])) == wanted
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["length"].cumsum() - g["length"] == g["offset"]).all() and g["length"].sum() <= 128
    assert packing.pack(docs.limit(0), path).count() == 0


def test_word_encoder_equals_the_library():
    path = P.path("word_bpe_49k.json")
    encoder = packing.WordEncoder(path)
    texts = ["", "It's  we'll don'T 'S", "a<|endoftext|>b", "x\x1cy \x0b z", "ΣΑΣ İstanbul ǅ", "123abc 4.5e6", "日本語、テスト。", "é ...?! (a)b", "word's", "a b　c", "‘quoted’—dash"]
    ids, starts = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_fill_is_optimal():
    counts = {7: 2, 5: 3, 4: 1}
    for room in range(1, 40):
        best = max(s for a in range(3) for b in range(4) for c in range(2) if (s := 7 * a + 5 * b + 4 * c) <= room)
        used = packing.fill(counts, room)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())


# ---- op9


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(8, 16))
    rows = [(i, (centers[i % 8] + rng.normal(size=16) * 0.06).tolist(), i % 2) for i in range(300)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] * 16, 1), (404, [1.0] * 16, None), (405, [], 1), (None, [1.0] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(frame).collect()}
    x = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows[:320]}
    label = {i: y for i, _, y in rows}
    links = {i: [j for j in x if j != i and label[i] == label[j] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.98] for i in x}
    found = sum(got[i][0] for i in x) / sum(map(len, links.values()))
    assert found >= 0.99 and all(got[i][0] <= len(links[i]) for i in x)
    for i in (400, 401, 402, 403, 404, 405):
        assert got[i] == (0, i, True)
    assert all(got[i][2] == (got[i][1] == i) for i in x)
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0


def test_shards_are_linked_to_one_another(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", 20)
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(8)[i % 8] + rng.normal(size=8) * 0.02).tolist(), 1) for i in range(100)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.component_id for r in got} == set(range(8))


def test_recall_across_shards(spark, monkeypatch):
    """Links of vectors of different shards, in a label of many, against brute force; some are tiny, some are huge."""
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", 60)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 12))
    x = centers[rng.integers(0, 40, 480)] + rng.normal(size=(480, 12)) * 0.12
    x *= np.where(np.arange(480) % 3 == 0, 1e-200, np.where(np.arange(480) % 3 == 1, 1e200, 1.0))[:, None]
    got = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")).collect()}
    u = vector_dedup.unit(x)
    wanted = ((u @ u.T) >= 0.98).sum(axis=1) - 1
    assert sum(got.values()) >= 0.98 * wanted.sum() > 500 and all(got[i] <= n for i, n in enumerate(wanted))


# ---- op10


def test_token_counts_equal_the_library(spark):
    path = P.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    texts = ["", None, "a  b", " lead", "trail ", "x\n y", "x \ny", "tab\t z", "it's we'll  'S", "a<|endoftext|> b", "123 45", "no  break", "é 日本語", "\x1c x\x1c y", "  ", "\n\n ", "word " * 700]
    docs = table(spark, list(enumerate(texts)) + [(None, "x y"), (0, "twice")])
    got = token_counts.token_counts(docs, path).collect()
    for r, row in zip(docs.collect(), got, strict=True):
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert (row.doc_id, row.n_bytes, row.n_tokens, row.over_limit) == (r.doc_id, len((r.text or "").encode()), n, n > 512)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
