"""Near texts against all pairs; line limits of any host size; letters and classes of every code point."""

import random
import re
import time

import numpy as np
import pytest

from flowloom.llm import bpe, bytecnn, common, neartext, quality, simhash, toxicity
from flowloom.llm.queries import tokenizer_path


def edited(rng, words, edits):
    out = list(words)
    for p in rng.sample(range(len(words)), edits):
        out[p] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def edits():
    """Families of texts with a few changed words each, unrelated texts, copies that differ in case and spaces, null and empty texts."""
    rng = random.Random(4)
    texts, vocabulary = [], [f"w{i}" for i in range(4000)]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(120, 400))]
        texts += [edited(rng, base, e) for e in (0, 1, 1, 2, 2, 3)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(150)]
    texts += [texts[0].upper(), texts[1].replace(" ", " \n"), None, "", " \t", "two words", "Two  Words"]
    return texts


def components_of(texts):
    sets = [shingles(t or "") if (t or "").split() else set() for t in texts]
    places = {}
    for i, s in enumerate(sets):
        for x in s or {()}:
            places.setdefault(x, []).append(i)
    pairs = {(p[0], q) for p in places.values() for q in p[1:]} | {(a, b) for p in places.values() if len(p) < 20 for a in p for b in p if a < b}
    near = [(a, b) for a, b in pairs if sets[a] == sets[b] or similarity(sets[a], sets[b]) >= 0.8]
    return near, simhash.forest(len(texts), np.array([a for a, _ in near]), np.array([b for _, b in near]))


@pytest.mark.parametrize("limits", [(neartext.PART_ROWS, neartext.PAIRS), (8, 4)])
def test_near_texts_equal_all_pairs(spark, edits, limits, monkeypatch):
    monkeypatch.setattr(neartext, "PART_ROWS", limits[0])
    monkeypatch.setattr(neartext, "PAIRS", limits[1])
    docs = spark.createDataFrame(list(enumerate(edits)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neartext.near_texts(docs).collect()}
    near, want = components_of(edits)
    assert len(got) == len(edits)
    for i, c in got.items():
        assert want[i] == want[c]  # no wrong link
    caught = [got[a] == got[b] for a, b in near]
    assert np.mean(caught) > 0.98
    assert np.mean([got[i] == w for i, w in enumerate(want.tolist())]) > 0.98
    stay = {r.doc_id for r in neartext.one_of_each(docs).collect()}
    assert stay == {i for i, c in got.items() if i == c}


def test_recall_by_similarity():
    """Share of single pairs that the sixteen fingerprints find, by similarity."""
    rng = random.Random(8)
    for edits, least in ((1, 0.99), (3, 0.97), (6, 0.8)):
        found = []
        for _ in range(150):
            base = [f"w{rng.randrange(5000)}" for _ in range(300)]
            s = np.frombuffer(b"".join(neartext.sketch(neartext.shingle_set(t)) for t in (" ".join(base), edited(rng, base, edits))), dtype=np.uint8).reshape(2, -1)
            v = neartext.bands_of(s)
            apart = [bin(x).count("1") for x in (v[0] ^ v[1]).tolist()]
            found.append(min(apart) <= 1 and neartext._apart(s[0], s[1]) <= neartext.budget(0.8))
        assert np.mean(found) >= least


def test_shortest_forest_and_groups():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(2, 40))
        a, b = rng.integers(0, n, (2, int(rng.integers(1, 80))))
        a, b = a[a != b], b[a != b]
        d = rng.integers(0, 5, len(a))
        kept = neartext.shortest_forest(n, a, b, d)
        assert len(kept) == n - len(set(simhash.forest(n, a, b).tolist()))
        for most in range(5):  # the same components at every threshold
            k = kept[d[kept] <= most]
            assert (simhash.forest(n, a[k], b[k]) == simhash.forest(n, a[d <= most], b[d <= most])).all()
    s = rng.integers(0, 2, (60, 48)).astype(np.uint8) * 255
    s[20:40] = s[0] ^ (rng.integers(0, 40, (20, 48)) == 0).astype(np.uint8)
    most = 6
    near = [(i, j) for i in range(60) for j in range(i) if neartext._apart(s[i], s[j]) <= most]
    i, j = neartext.linked_group(s, most)
    assert all(neartext._apart(s[x], s[y]) <= most for x, y in zip(i, j, strict=True))
    assert (simhash.forest(60, i, j) == simhash.forest(60, *(np.array(x) for x in zip(*near, strict=True)))).all()


def test_long_lines_on_a_large_host(spark):
    """A passage in a small share of a large host goes; a short line of the same share stays."""
    rng = random.Random(1)

    def words(n):
        return " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))

    passage = "this same passage of more than ten words stands in many documents of the host"
    rows = []
    for i in range(1500):
        own = words(40)
        extra = f"{passage}\nshort line" if i < 40 else ""
        rows.append((i, f"{own}\n{extra}".strip(), "big"))
    rows += [(5000 + i, f"{words(40)}\n{passage}", "small") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert all(got[i].n_removed_lines == 1 and got[i].kept for i in range(40))
    assert all(got[5000 + i].n_removed_lines == 0 for i in range(20))  # not above the limit there
    assert all(got[i].n_removed_lines == 0 for i in range(40, 1500))
    kept = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert passage not in kept[3] and "short line" in kept[3]


def test_null_and_empty_texts_are_one_text(spark):
    docs = spark.createDataFrame([(1, None, "h"), (2, "", "h")], "doc_id long, text string, source string")
    assert len({r.text_key for r in quality.base_metrics(docs).collect()}) == 1


def test_no_letter_is_und(spark):
    train = spark.createDataFrame([(i, f"some english words {i} here", "en") for i in range(30)], "doc_id long, text string, lang string")
    texts = ["½ ² ①", "Ⅷ", "123", "_", None, "", "é", "中"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in bytecnn.predict(docs, bytecnn.fit(train), common.crc_part(4, 2)).collect()}
    assert [got[i] for i in range(len(texts))] == ["und"] * 6 + ["en"] * 2


def test_code_point_classes_equal_the_library():
    """Every code point is a letter, a number or neither, and lower-cased, as the library has it."""
    from tokenizers import Regex, normalizers, pre_tokenizers
    vocab = bpe.vocabulary(tokenizer_path())
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for name in "LN":
        mine = re.compile(f"[{bpe._class(name)}]").match
        split = pre_tokenizers.Split(Regex(rf"\p{{{name}}}+"), behavior="removed")
        for lo in range(0, len(points), 8192):
            some = points[lo:lo + 8192]
            rest = {p for s, _ in split.pre_tokenize_str("\x00".join(some)) for p in s}
            assert not [hex(ord(c)) for c in some if bool(mine(c)) == (c in rest)]
    lower = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
    assert not [hex(ord(c)) for c in points if vocab.normalise(c) != lower.normalize_str(c)]


def test_many_exception_phrases_take_linear_time():
    lexicon = toxicity.Lexicon((("trash", 2.0),), 1.0, 0.0)
    assert toxicity.raw_score("trash can", lexicon) == 0 and toxicity.raw_score("trash talk trash can", lexicon) > 0
    began = time.time()
    assert toxicity.raw_score("trash can " * 100_000, lexicon) == 0
    assert time.time() - began < 5


def test_near_texts_lose_no_link_to_a_refused_one(spark):
    """Texts close to the limit: components are those of all candidates that hold, also where the check refuses links of the forest."""
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(12):
        base = [f"w{w}" for w in rng.integers(0, 10**6, 80)]
        for _ in range(14):
            own = list(base)
            for at in rng.choice(80, 1):
                own[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    sets = [neartext.shingle_set(t) for t in texts]
    sketches = np.frombuffer(b"".join(map(neartext.sketch, sets)), dtype=np.uint8).reshape(len(texts), -1)
    bands = neartext.bands_of(sketches)
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            apart = [bin(int(x)).count("1") for x in bands[i] ^ bands[j]]
            shared = len(np.intersect1d(sets[i], sets[j]))
            if min(apart) <= 1 and neartext._apart(sketches[i], sketches[j]) <= neartext.budget(0.8) and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neartext.near_texts(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > 12


def test_links_are_checked_on_texts_that_travel_whole(spark, monkeypatch):
    """Every link of a hub and between others is judged as by brute force, also when a task keeps few sets; no set is shuffled."""
    monkeypatch.setattr(neartext, "SETS", 2)
    monkeypatch.setattr(neartext, "LINKS", 4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] + [" ".join([*words[:50 + i], *(f"x{i}-{j}" for j in range(10 - i))]) for i in range(10)] + ["", None, "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = {neartext.text_key(t): neartext.shingle_set(t) for t in texts}
    pairs = [(u, v) for u in key for v in key if u < v]
    links = spark.createDataFrame(pairs, "u long, v long")
    checked = neartext.checked_links(docs, links)
    assert "shingles" not in checked._jdf.queryExecution().optimizedPlan().toString()
    shared = lambda u, v: len(np.intersect1d(key[u], key[v]))
    want = {(u, v) for u, v in pairs if shared(u, v) >= 0.8 * (len(key[u]) + len(key[v]) - shared(u, v))}
    assert want and len(want) < len(pairs)
    assert sorted(tuple(r) for r in checked.collect()) == sorted(want)
