"""The operators on Merkle trees, languages and spellings: against plain Python, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylab.llm import common, language, merkle, spelling

SF = "/root/testdata/sf0.01"
LONG_RUN = "abcdefgh" * 2000
DOCUMENTS = "doc_id long, source string, lang string, n_chars int, text string"


def hash_of(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_hand(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: hash_of([field(x) for x in r])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([hash_of(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(((r[0] is not None, r[0] or 0, leaf(r)), leaf((*r[:4], r[4] and r[4].replace("\n", "")))))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([key[2] for key, _ in sorted(sources[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    for n, s in enumerate(order):
        for i, (key, other) in enumerate(sorted(sources[s])):
            proof, node = [], other
            for levels, at in ((trees[s], i), (top, n)):
                for nodes in levels[:-1]:
                    first = at - at % 3
                    run = nodes[first : first + 3]
                    proof += run[: at - first] + run[at - first + 1 :]
                    node, at = hash_of([*run[: at - first], node, *run[at - first + 1 :]]), at // 3
            yield key[1] if key[0] else None, key[2], trees[s][-1][0], top[-1][0], hash_of(proof), node, node == top[-1][0]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    """Trees of many and of few leaves by blocks of 3, 9 and 729 nodes; nulls, ties, equal rows, a null source, a long text, more columns."""
    random.seed(3)
    sizes = {None: 1, "": 9, "a": 40, "é": 10, "zz": 3}
    rows = [(random.choice([None, 1, 2, i, i]), s, random.choice([None, "en"]), random.choice([None, 3]), random.choice([None, "", "x\ny", f"t{i}", "w\n" * 9999])) for s, n in sizes.items() for i in range(n)]
    rows += [(7, "a", None, None, "same")] * 5
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5).withColumns({c: F.lit("clash") for c in ("tree", "at", "node", "item", "_part", "total")})
    got = merkle.manifest(docs, F.replace("text", F.lit("\n"), F.lit("")), height=height).collect()
    assert sorted(map(tuple, got), key=str) == sorted(manifest_by_hand(rows), key=str)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_nothing_and_of_one_row(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], DOCUMENTS)
    assert merkle.manifest(docs.limit(0), F.col("text")).count() == 0
    (only,) = merkle.manifest(docs, F.col("text")).collect()
    assert only.leaf == only.subroot == only.root == only.folded_root == hash_of(["1:1----"]) and only.verified and only.proof_sha256 == hash_of([])


def variants_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    less = {w: {w[:i] + w[i + 1 :] for i in range(len(w))} for w in words}
    same = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and (same(v, w) or v in less[w] or w in less[v])] for w in words}
    form = {}
    for w, vs in near.items():
        if vs and words[best := min(vs, key=lambda v: (-words[v], v))] >= 10 * words[w]:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n, len(near[w]), words.get(form.get(w))


def test_spelling_variants(spark):
    """Every kind of edit, at both ends and in the middle, in repeated letters and beside letters beyond ASCII; chains of forms; runs of any length."""
    random.seed(5)
    base = ["language", "aaaaaaa", "étrangère", "Straßenbahn", "mississippi", "x" * 40]
    edits = lambda w: [w[:i] + c + w[j:] for i in range(len(w)) for j in (i, i + 1) for c in ("", "a", "é")]
    words = [w for b in base for w in [b] * 120 + random.sample(edits(b), 9) * 2 + random.sample(edits(b), 3) * 11]
    words += ["".join(random.sample("abcdefgh", 8)) for _ in range(3000)] + [LONG_RUN, LONG_RUN, LONG_RUN + "x", LONG_RUN + "x", "LANGUAGE", "×÷×÷×÷×", "×÷×÷×÷×"]
    words += ["chaining"] * 400 + ["chainint"] * 33 + ["chainnnt"] * 3
    random.shuffle(words)
    rows = [(i % 50 if i % 7 else None, " ".join(words[i * 20 : i * 20 + 20])) for i in range(len(words) // 20 + 1)] + [(1, None), (2, ""), (3, "12 . short"), (4, "repeated repeated"), (4, "repeated repeated")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "key", "form", "root", "half", "_run", "_id")})
    got = sorted(map(tuple, spelling.spelling_variants(docs).collect()))
    assert got == sorted(variants_by_hand(rows))
    assert sum(r[1] is not None for r in got) > 20 and ("chainnnt", "chainint", "chaining") in [r[:3] for r in got]
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_anagrams_do_not_meet_all(spark):
    """All orders of the same letters share a key; only those whose halves agree are compared."""
    import itertools

    words = spark.createDataFrame([("".join(p), 5) for p in itertools.permutations("abcdefg")], "word string, n long")
    assert spelling.near_words(words).count() == 0
    keys = words.select(spelling.anagram_key(F.col("word")).alias("key")).distinct().collect()
    assert [r.key for r in keys] == [sum(ord(c) ** 5 for c in "abcdefg")]


def test_no_side_of_multiplied_words_is_broadcast(spark):
    """Spark sizes the words' keys and halves by the words' small file; the joins don't go by that, nor do those of the forms."""
    rows = [("language", 40), ("languages", 3), ("langage", 2), ("mississippi", 2)]
    words = common.stage(spark.createDataFrame(rows, "word string, n long"), "words")
    near = spelling.near_words(words)
    assert sorted(map(tuple, near.collect())) == [("langage", "language", 40), ("language", "langage", 2), ("language", "languages", 3), ("languages", "language", 40)]
    found = spelling.spelling_variants(spark.createDataFrame([(1, " ".join(w for w, n in rows for _ in range(n)))], "doc_id long, text string"), slip=1 << 40)
    assert ("languages", "language", "language", 3, 1, 40) in [*map(tuple, found.collect())]
    for df in (near, found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_kernels():
    """The kernel is the number of shared runs by the root of the product of both numbers of runs."""
    texts = ["Der Hund, der bellt!", "the dog that barks", "", "日本語のテキスト", "  Éàü 12 É ", "ab " * 500_000]

    def runs(text):
        plain = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
        return {plain[i : i + n] for n in language.SPECTRUM for i in range(len(plain) - n + 1)}

    rows = np.zeros((len(texts), 1 << language.BITS), bool)
    for text, row in zip(texts, rows):
        language.presence(text, row)
    sets = [runs(t) for t in texts]
    assert [int(r.sum()) for r in rows] == [len(s) for s in sets]  # no two of these runs share a bucket
    got = language.Kernels(np.packbits(rows, axis=1))(texts)
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(got, want, atol=1e-6)


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    aside = language.held_out(F.col("doc_id"))
    found = language.language_id(docs.where(aside), language.train(docs.where(~aside), most_rows=400, landmarks=40))
    assert found.join(docs, "doc_id").where("lang = lang_pred").count() >= 0.98 * docs.where(aside).count()
    assert docs.where(aside).count() == sum(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.collect()) == found.count()


def test_languages_of_awkward_rows(spark):
    labelled = [(i, t, lang) for i in range(30) for lang, t in (("en", f"the cat and the dog of the house {i}"), ("de", f"der Hund und die Katze in dem Haus {i}"), (None, "no label"), ("xx", None), ("yy", "123"))]
    train = common.stage(spark.createDataFrame(labelled, "doc_id long, text string, lang string"), "rows")
    model = language.train(train)
    assert model.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "12 ?!"), (4, "the house"), (5, "das Haus und der Hund"), (6, "the house and the dog " * 50_000), (6, "the house"), (None, "THE HOUSE OF THE CAT"), (8, "漢字"), (9, "é1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("lang", "score", "lang_pred", "n", "dealt")})
    got = sorted(((r.doc_id, r.lang_pred) for r in language.language_id(docs, model).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "en"), (6, "en"), (None, "en"), (8, "de"), (9, "de")], key=str)
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und" or r.doc_id == 8) for r in language.language_id(docs, model).where("doc_id <> 9").collect())
    assert {r.lang_pred for r in language.language_id(docs, language.train(train.where("lang in ('xx', 'yy')"))).collect()} == {"und"}
    assert language.language_id(docs.limit(0), model).count() == 0 and language.train(train.limit(0)) is None
