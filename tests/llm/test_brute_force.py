"""Each operator against a plain version of its contract, on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import zstandard

import corpus_pipeline
from wardcast.llm import (
    decontaminate, exact_dedup, fixity, jaccard, mixing, queries, secret_scan, token_output, toxicity, url_rules,
)
from wardcast.llm.components import smallest_reachable
from wardcast.llm.signature_tree import Threshold, Tree, Widths, common, pairs, shingle_sets

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edited(own, share):
    parts = own.split()
    for i in range(len(parts)):
        if RNG.random() < share:
            parts[i] = RNG.choice(WORDS)
    return " ".join(parts)


@pytest.fixture(scope="module")
def family():
    """Texts with exact and near copies, short and empty ones, shared passages."""
    passage = text(40)
    out = []
    for _ in range(25):
        own = text(RNG.choice([2, 3, 10, 60, 200]))
        out += [own, own]
        out += [edited(own, RNG.choice([0.005, 0.01, 0.03, 0.1])) for _ in range(RNG.randint(0, 12))]
    out += [f"{text(30)} {passage} {text(5)}" for _ in range(30)]
    out += ["", None, "  \n", "one", "One", "one two", "A B C", "a b\tc"]
    return list(enumerate(out))


def components_by_pairs(rows, size, part, over):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    above = {i: i for i in sets}

    def find(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if over * both >= part * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    above[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size, part, over", [(3, 90, 100), (5, 4, 5)])
@pytest.mark.parametrize("limits", [{}, {"small": 2, "task": 500, "rays": 3, "repeats": 2, "frequent": 50}])
def test_jaccard_components(spark, family, size, part, over, limits):
    near = jaccard.Near(words=size, threshold=Threshold(part, over), **limits)
    docs = spark.createDataFrame(family, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs, near=near).collect()}
    assert got == components_by_pairs(family, size, part, over)


def test_one_of_each_keeps_smallest_of_each_component(spark, family):
    docs = spark.createDataFrame(family, "doc_id long, text string")
    kept = {r["doc_id"] for r in jaccard.one_of_each(docs).collect()}
    assert kept == {root for _, root in components_by_pairs(family, 5, 4, 5).values()}


def test_one_of_each_goes_by_row(spark):
    a, b = text(40), text(40)
    near_a = a + " more"
    rows = [(1, a, "x"), (2, near_a, "x"), (2, b, "x"), (None, a, "x"), (3, b, "x"), (4, a, "x"), (4, a, "x"), (None, text(30), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    # The text of the second row 2 is like that of row 3 only; of rows 4 none stays.
    assert sorted((r["doc_id"] or 0, r["text"] == b) for r in left.collect()) == [(0, False), (1, False), (2, True)]
    twins = spark.createDataFrame([("k", a, 1), ("k", a, 1), ("l", "", 1), ("l", "", 1), (None, b, 1), (None, b, 1)], "doc_id string, text string, _rank int")
    got = sorted((r["doc_id"] or "", r["text"]) for r in jaccard.one_of_each(twins).collect())
    assert got == sorted([("k", a), ("l", ""), ("l", ""), ("", b)])


def test_large_blocks_give_links_only(spark):
    """A dense block of near copies, most of them in no star of each other, cut into many parts."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = list(base)
        for k in range(i % 12):
            own[(i * 7 + k * 5) % 60] = f"x{i}{k}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = jaccard.Near(small=2, task=3_000)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs, near=near).collect()}
    assert got == components_by_pairs(rows, 5, 4, 5)
    found = jaccard.shingle_sets([t for _, t in rows], 5)
    part = pd.DataFrame({"node": range(400), "n": 0, "elements": [f.tobytes() for f in found]})
    part["n"] = [len(e) // 8 for e in part["elements"]]
    part = part.assign(root=part["node"], tile=part["node"], centre=False, h=1, p=0, q=0, first=True)
    links = jaccard.linked_parts(near, part)
    assert 0 < len(links) < 400 and len(set(map(tuple, links.to_numpy()))) == len(links)


def test_traversal_loses_no_link():
    threshold, widths = Threshold(9, 10), Widths(32, 64, 256)
    sets = []
    for _ in range(60):
        base = [RNG.getrandbits(64) for _ in range(RNG.choice([3, 20, 31, 33, 120]))]
        for _ in range(RNG.randint(1, 5)):
            own = [RNG.getrandbits(64) if RNG.random() < 0.02 else x for x in base]
            sets.append(np.unique(np.array(own, np.uint64)))
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    rows = widths.stacked([widths.signature(s).tobytes() for s in sets], n)
    wanted = {
        (i, j)
        for i in range(len(sets))
        for j in range(i + 1, len(sets))
        if threshold.links(n[i], n[j], common(sets[i], sets[j]))
    }
    groups = np.arange(len(sets))
    own = {(int(a), int(b)) for x, y in pairs(Tree(rows, n, groups), None, threshold) for a, b in zip(x, y)}
    assert wanted <= own and len(wanted) > 50
    cut = len(sets) // 3
    parts = Tree(rows[:cut], n[:cut], groups[:cut]), Tree(rows[cut:], n[cut:], groups[cut:])
    across = {(int(a), int(b) + cut) for x, y in pairs(*parts, threshold) for a, b in zip(x, y)}
    assert {p for p in wanted if p[0] < cut <= p[1]} <= across
    # Pairs of one group are passed over.
    assert not list(pairs(Tree(rows, n, np.zeros(len(sets), int)), None, threshold))


def test_shingles_are_alike_at_any_offset_and_length():
    long = "ab cd " * 200_000 + "q" * 1_200_000 + " zz yy"
    found = list(shingle_sets([long, "ab cd ab", "x ab cd ab", None, " \n", "Ab  cD\tab"], 3))
    assert found[1][0] in found[0] and found[1][0] in found[2]
    assert list(found[5]) == list(found[1])
    assert [len(f) for f in found] == [5, 1, 2, 0, 0, 1]


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(80)}


def test_exact_duplicates_with_colliding_identifiers(spark):
    rows = [(i, RNG.choice(["a  b", "a b", "a\nb ", "", None, " ", text(3000), "x" * 40_000]) or "") for i in range(60)]
    rows += [(i + 60, t) for i, t in rows] + [(999, None), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    wanted = sorted(
        (i is None, i or 0, min(j for j in g if j is not None), len(g), hashlib.sha256(t.encode()).hexdigest())
        for t, g in groups.items()
        for i in g
    )
    for id_bytes in (16, 0):  # without bytes only lengths tell chunks apart
        got = exact_dedup.exact_duplicates(docs, id_bytes=id_bytes).collect()
        assert wanted == sorted(
            (r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["text_sha256"]) for r in got
        )
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_chunks_follow_content():
    own = " ".join(text(5) for _ in range(6000)).encode()
    assert b"".join(exact_dedup.chunks(own)) == own
    assert b"".join(exact_dedup.chunks(b"a" * 3_000_000)) == b"a" * 3_000_000
    moved = exact_dedup.chunks(b"something else in front " + own)
    shared = set(exact_dedup.chunks(own)) & set(moved)
    assert len(shared) > 0.8 * len(moved)


def distance_to_part(pattern, own):
    row = [0] * (len(own) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, w in enumerate(own, 1):
            last, row[j] = row[j], min(last + (p != w), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_bit_parallel_distance():
    for _ in range(300):
        pattern = [RNG.choice("abcd") for _ in range(RNG.randint(1, 70))]
        own = [RNG.choice("abcd") for _ in range(RNG.randint(0, 60))]
        got, end = decontaminate.best_end(decontaminate.masks(pattern), len(pattern), own)
        assert got == distance_to_part(pattern, own)
        assert end == 0 or distance_to_part(pattern, own[:end]) == got


def test_items_are_found_within_their_budget(spark):
    edits = decontaminate.Edits()
    items = [(i, text(RNG.choice([8, 15, 30, 60]))) for i in range(12)]
    docs = []
    for i in range(150):
        own = text(RNG.randint(0, 120)).split()
        if i % 2:
            part = items[i % 12][1].split()
            for _ in range(RNG.randint(0, 6)):
                at = RNG.randrange(len(part))
                part[at : at + RNG.randint(0, 1)] = [RNG.choice(WORDS)] * RNG.randint(0, 1)
            at = RNG.randint(0, len(own))
            own[at:at] = part
        docs.append((i, ", ".join(own).upper()))
    for block in (1_000_000, 40):  # all items in one block, or few words in each
        found = decontaminate.held_items(
            frame := spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"),
            block=block,
        )
        got = {r["doc_id"]: {(x["item_id"], x["distance"]) for x in r["f"]} for r in frame.select("doc_id", found.alias("f")).collect()}
        for i, t in docs:
            w = decontaminate.words(t)
            near = {(k, distance_to_part(p := decontaminate.words(x), w)) for k, x in items}
            assert got[i] == {(k, d) for k, d in near if d <= edits.of(len(decontaminate.words(dict(items)[k])))}
    assert sum(map(bool, got.values())) > 15


@pytest.mark.parametrize(
    "item, held, free",
    [
        ("What is the capital of France?", "so: what IS the capital, of france", "what is the old capital of france"),
        ("法国的首都是哪里", "他问法国的首城是哪里，没人知道", "他问德国的首城在哪里"),
        ("東京", "夏の東京は暑い", "東の京"),
        ("ประเทศไทย", "ในประเทศไทยวันนี้", "ในประเดคไทย"),
        (" ".join(f"q{i}" for i in range(200)), " ".join("x" if i % 10 == 3 else f"q{i}" for i in range(200)), " ".join("x" if i % 7 == 3 else f"q{i}" for i in range(200))),
    ],
)
def test_short_unspaced_and_long_items(spark, item, held, free):
    docs = spark.createDataFrame([(1, held), (2, free)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, " ?! "), (3, "")], "item_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["items"]] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: [1], 2: []}


def test_index_finds_the_nearest(spark):
    settings = toxicity.Settings(neighbours=7, block=4, first_blocks=1)
    idf = {t: 1 + RNG.random() * 3 for t in "abcdefghij"}
    rows = [
        (i, RNG.randint(0, 1), {t: RNG.randint(1, 4) for t in RNG.sample(sorted(idf), RNG.randint(0, 4))})
        for i in range(300)
    ]
    index = toxicity.Index(idf, rows, settings)

    def unit(counts):
        own = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in own.values()))
        return {t: w / norm for t, w in own.items()}

    classes = defaultdict(list)
    for i, y, c in rows:
        if c:
            classes[tuple(sorted(c.items()))].append((i, y))
    for _ in range(200):
        query = {t: RNG.randint(1, 4) for t in RNG.sample(sorted(idf), RNG.randint(1, 4))}
        q = unit(query)
        near = [
            (-round(sum(q.get(t, 0) * w for t, w in unit(dict(k)).items()), 9), min(i for i, _ in g), g)
            for k, g in classes.items()
        ]
        near = sorted((x for x in near if x[0] < 0), key=lambda x: x[:2])[: settings.neighbours]
        found, cosines = index.nearest(index.key(query))
        assert index.ids[found].tolist() == [x[1] for x in near]
        assert np.allclose(cosines, [-x[0] for x in near])


def test_harmless_texts_stay_whatever_the_rate(spark):
    from pyspark.sql import functions as F

    rows = [(f"id{i}", f"harmless words number {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"id{i}", int(i % 3 == 0)) for i in range(60)], "doc_id string, toxic int")
    assert toxicity.without_toxic(docs, docs, labels).count() == 200
    # Ids of any type are returned as they are; an id that repeats is one example.
    more = [(f"t{i}", "vile words of hate") for i in range(40)] + [("t0", f"other {i}") for i in range(50)]
    marked = labels.union(spark.createDataFrame([(f"t{i}", 1) for i in range(40)], labels.schema))
    both = docs.union(spark.createDataFrame(more, docs.schema))
    got = toxicity.score_documents(both, marked, F.lit(False)).filter("doc_id LIKE 't%'")
    vile = [r for r in got.collect() if r["score"] > 0.8]
    assert len(vile) >= 39 and all(n.startswith("t") for r in vile for n in r["neighbours"])


def test_toxicity_learns_words_on_held_out_rows(spark):
    bad = ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 7 == 0
        own = text(40).split()
        if toxic:
            own[5:5] = RNG.sample(bad, 2)
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_documents(docs, marked, held).collect()
    own = [r for r in got if r["held_out"]]
    assert len(own) > 300 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["predicted"] == dict(labels)[r["doc_id"]] for r in own)
    assert all(0 <= r["score"] <= 1 for r in got)
    # Labels of held-out rows are not looked at.
    wrong = marked.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, wrong, held).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}


def test_every_significant_term_is_learned(spark):
    own = ["".join(c) for c in itertools.product("bcdfghjkl", "aeiou", "mnpqr", "stvwz")][:700]
    toxic = [(i, f"plain {' '.join(own[k] for k in range(700) if k % 100 == i % 100)}") for i in range(600)]  # in 6 texts each
    toxic += [(i, "weak") for i in range(600, 605)]
    rows = toxic + [(i, "plain words of no kind") for i in range(605, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 605)) for i, _ in rows], "doc_id long, toxic int")
    learned = toxicity.learn(docs, labels, "toxic", "doc_id", "text", toxicity.Settings())
    assert set(learned["idf"]) == {*own, "weak"}
    index = toxicity.Index(learned["idf"], learned["rows"], toxicity.Settings())
    score, neighbours, found = index.score(toxicity.terms("weak"))
    assert score > 0.8 and found == ["weak"] and neighbours == [600]  # equal vectors have one entry


def plain_secrets(t):
    spans = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 6:
            spans.append((m.start(), 0, m.end(), "assign"))
    for k, (kind, pattern, least) in enumerate([("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)], 1):
        spans += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, t) if len(m[0]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def test_secrets(spark):
    parts = [
        "password=hunter22", "ſecret: abcdefg", "Token : 'abc.def-1'", "token=token: abcdef1", "api_key='x", "APIKEY=\"abcdef",
        "AKIA" + "A1" * 8, "AKIAshort", "0123456789abcdef01234567", "deadbeef" * 4, "ABCDEF" * 5, "üñ", "secret = ", "passwd:=abcdef",
        "K" * 30, "9f86d081-884c-7d65-9a2f-eaa0c55ad015", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "some_long_identifier_of_words",
    ]
    rows = [(i, RNG.choice([" ", "\n", ""]).join(RNG.choices(parts, k=RNG.randint(0, 9)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {r["doc_id"]: r["found"] for r in secret_scan.find_secrets(docs).collect()}
    got = secret_scan.find_secrets(docs, reveal=True).collect()
    for r in got:
        assert hashed[r["doc_id"]] == [hashlib.sha256(f.encode()).hexdigest() for f in r["found"]]
        t = dict(rows)[r["doc_id"]]
        base = plain_secrets(t)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        kinds = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        for span, found in zip(filter(None, r["spans"].split(",")), r["found"]):
            _, a, b = span.split(":")
            assert t[int(a) : int(b)] == found


@pytest.mark.parametrize(
    "run, secret",
    [
        ("wJalrXUtnFEMIK7MDENGbPxRfiCYzEXkq93", True),
        ("ghp_x8Kd02LqPz7TnVb41RmYw6JcHs3FuEa9oQ5i", True),
        ("9f86d081-884c-7d65-9a2f-eaa0c55ad015", False),
        ("D41D8CD98F00B204E9800998ECF8427E", False),
        ("internationalization_of_documents", False),
        ("UnbelievablyLongCamelCaseIdentifierName", False),
        ("2024-01-01-12345678901234567890", False),
        ("=" * 60, False),
        ("abababababababababababab12121212", False),
    ],
)
def test_token_efficiency(run, secret):
    assert bool(secret_scan.scan(f"see {run} here")["n_random"]) == secret


@pytest.mark.parametrize(
    "run, secret",
    [
        ("Zk9Qw3" + "0123456789abcdef01234567" + "Pq7LmX2vTb88", True),
        ("0123456789abcdef01234567" + "ZPq7LmX2vTk8Rw" + "fedcba987654321001234567", True),
        ("sha256-" + "9f86d081884c7d65" * 4, False),
        ("owner/documents/blob/" + "9f86d081884c7d659a2f" * 2 + "/library/text", False),
        ("0123456789abcdef01234567", False),
        ("AKIA" + "A1" * 8 + "Zk", False),
    ],
)
def test_runs_around_base_spans(run, secret):
    got = secret_scan.scan(f"see {run} here")
    assert got["n_random"] == secret and (f"random:4:{4 + len(run)}" in got["spans"].split(",")) == secret


def test_many_base_spans_in_one_text():
    """Time grows with the text, not with the product of runs and spans."""
    text = " ".join(f"{i:024x} x8Kd02LqPz7TnVb41RmYw6JcHs3FuEa9oQ5i" for i in range(30_000))
    got = secret_scan.scan(text)
    assert got["n_hex"] == got["n_random"] == 30_000


def test_random_strings_after_fillers():
    key = "x8Kd02LqPz7TnVb41RmYw6JcHs3FuEa9oQ5i"
    varied = "".join(RNG.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=2000))
    for run in ("A" * 256 + key, "A" * 300 + key + "Z" * 700, "-_" * 400 + key, "A" * 300 + varied, "a/b/" * 80 + varied):
        assert secret_scan.scan(f"see {run} here")["spans"] == f"random:4:{4 + len(run)}"
    for run in ("A" * 1000, "ab" * 500, "a/b-" * 200, "A" * 500 + "internationalization_of_documents"):
        assert not secret_scan.scan(f"see {run} here")["n_random"]


def test_url_verdicts(spark):
    rules = [url_rules.parse_rule(*r) for r in [("allow", "org/"), ("block", "example.org/es/"), ("block", "com/de/")]]
    cases = {
        "http://WWW.Example.ORG/es/1?x": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/esp": ("example.org", "/esp", "org/", "allow"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://a.com/de/#x": ("a.com", "/de/", "com/de/", "block"),
        "http://a.com?x=/de/": ("a.com", "", None, "allow"),
        "http://a.net/porn/x": ("a.net", "/porn/x", None, "block"),
        "http://a.net/pornography": ("a.net", "/pornography", None, "allow"),
        "http://a.org/porn": ("a.org", "/porn", "org/", "allow"),
        "http://a.net/adult": ("a.net", "/adult", None, "allow"),
        "http://a.net/adult-adult": ("a.net", "/adult-adult", None, "allow"),
        "http://a.net/adult/nude.html": ("a.net", "/adult/nude.html", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "XXX": ("", "", None, "block"),
        "x://y://z/a": ("y:", "//z/a", None, "allow"),
        "": ("", "", None, "allow"),
    }
    frame = spark.createDataFrame([*enumerate(cases), (99, None)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(frame, rules).collect()}
    assert got == dict(enumerate(cases.values())) | {99: ("", "", None, "allow")}


def test_permutation_is_one_and_can_be_undone():
    for count in (1, 2, 3, 5, 16, 17, 1000, 4097):
        out = token_output.permuted(np.arange(count), count, key=5)
        assert sorted(out.tolist()) == list(range(count))
        assert token_output.permuted(out, count, key=5, back=True).tolist() == list(range(count))
    assert token_output.permuted(np.arange(1000), 1000, 5).tolist() != token_output.permuted(np.arange(1000), 1000, 6).tolist()


def unpacked(records) -> dict:
    """The tokens of each document from the records that hold its parts."""
    found = []
    for r in records:
        ids, at = np.frombuffer(r["record"], "<u2"), 0
        assert len(r["doc_ids"]) == len(r["parts"]) == len(r["n_tokens"])
        for i, part, n in zip(r["doc_ids"], r["parts"], r["n_tokens"]):
            found.append((part, i, ids[at : at + n].tolist()))
            at += n
    parts = defaultdict(list)
    for _, i, tokens in sorted(found, key=lambda f: f[0]):
        parts[i] += tokens
    return parts


def test_records_round_trip_and_shards_resume(spark, tmp_path):
    layout = token_output.Layout(sequence=16, shard=8, partition=32)
    rows = [(i, text(RNG.randint(0, 60)) + " ünï") for i in range(50)] + [(50, ""), (51, None), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    records = token_output.training_records(docs, layout=layout).cache()
    got = records.collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert all(len(r["record"]) == layout.stride and r["byte_offset"] == r["slot"] % 8 * layout.stride for r in got)
    codec = token_output.encoding(layout.vocabulary)
    parts = unpacked(got)
    for i, t in rows[:-2]:
        assert parts[i][-1] == layout.end_token and codec.decode(parts[i][:-1]) == (t or "")
    assert parts[51] == [layout.end_token] * 2
    assert sum(sum(r["n_tokens"]) < layout.sequence for r in got) <= 3  # only the last of a writing task is filled up

    folder = str(tmp_path / "shards")
    first = token_output.write_shards(records, folder, layout).collect()
    assert sum(r["records"] for r in first) == len(got) and all(r["written"] for r in first)
    in_order = [r["record"] for r in sorted(got, key=lambda r: r["slot"])]
    assert [x.tobytes() for x in token_output.read_slots(folder, 0, 10**6, layout)] == in_order
    assert [x.tobytes() for x in token_output.read_slots(folder, 13, 30, layout)] == in_order[13:30]
    torn = tmp_path / "shards" / token_output.shard_name(1)
    torn.write_bytes(torn.read_bytes()[:-5])
    again = token_output.write_shards(records, folder, layout).collect()
    assert [r["shard"] for r in again if r["written"]] == [1]
    assert [x.tobytes() for x in token_output.read_slots(folder, 0, 10**6, layout)] == in_order


def test_rows_come_from_written_shards(spark, tmp_path):
    layout = token_output.Layout(sequence=16, shard=8, partition=32)
    docs = spark.createDataFrame([(2**60 + 1, text(300)), (None, text(40)), (3, "")], "doc_id long, text string").repartition(3)
    folder = f"{tmp_path}/shards"
    rows = token_output.sharded_records(docs, layout=layout, to=f"file://{folder}")
    got = sorted(rows.collect(), key=lambda r: r["slot"])
    assert set(unpacked(got)) == {2**60 + 1, None, 3}
    assert [r["record"] for r in got] == [x.tobytes() for x in token_output.read_slots(folder, 0, 10**6, layout)]
    for r in got:
        with open(r["path"], "rb") as file:
            data = file.read()
        assert zlib.crc32(data) == r["shard_crc32"] and r["path"] == f"{folder}/{token_output.shard_name(r['shard'])}"
        assert data[r["byte_offset"] :][: layout.stride] == r["record"] and zlib.crc32(r["record"]) == r["crc32"]
    assert sorted(rows.collect(), key=lambda r: r["slot"]) == got


@pytest.mark.parametrize("size", [0, 2_048])
def test_sequences_are_opened_as_they_were(size):
    layout = token_output.Layout(sequence=64, dictionary=size)
    ids = [np.array([RNG.randint(0, 300) for _ in range(64)], "<u2").tobytes() for _ in range(500)]
    words = zstandard.train_dictionary(size, ids).as_bytes() if size else b""
    held = token_output.squeezed(words, pd.Series([*ids, ids[0][:6]])).tolist()
    assert token_output.opened(words, layout, [*held, None]) == [*ids, ids[0][:6] + b"\x50\xc4" * 61, None]


def test_a_broken_run_goes_on_and_stale_shards_are_not_read(spark, tmp_path, monkeypatch):
    layout = token_output.Layout(sequence=16, shard=8, partition=32)
    docs = spark.createDataFrame([(f"d{i}", text(30)) for i in range(60)], "doc_id string, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    docs, to = spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/shards"
    first = sorted(token_output.sharded_records(docs, layout=layout, to=to).collect(), key=lambda r: r["slot"])
    times = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "shards").glob("shard-*.bin")}
    lacking, torn = tmp_path / "shards" / token_output.shard_name(1), tmp_path / "shards" / token_output.shard_name(2)
    lacking.unlink()
    torn.write_bytes(torn.read_bytes()[:-3])

    def encoded(*_):
        raise AssertionError("encoded again")

    monkeypatch.setattr(token_output, "write_sequences", encoded)
    again = token_output.sharded_records(docs, layout=layout, to=to)
    assert sorted(again.collect(), key=lambda r: r["slot"]) == first
    changed = {p.name for p in (tmp_path / "shards").glob("shard-*.bin") if p.stat().st_mtime_ns != times[p.name]}
    assert changed == {lacking.name, torn.name}
    for other, own in ((docs.limit(20), layout), (docs, token_output.Layout(sequence=16, shard=8, partition=32, key=3))):
        with pytest.raises(ValueError, match="another input or layout"):
            token_output.sharded_records(other, layout=own, to=to)
    count = len(first)
    (tmp_path / "shards" / token_output.shard_name(count // 8 + 1)).write_bytes(b"x" * 8 * layout.stride)
    assert len(list(token_output.read_slots(to, 0, 10**6, layout))) == count
    bad = bytearray(lacking.read_bytes())
    bad[5] ^= 1
    lacking.write_bytes(bytes(bad))
    with pytest.raises(Exception, match="differs from what was written"):
        token_output.sharded_records(docs, layout=layout, to=to).collect()


def test_query_and_stage_write_shards(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for found in (queries.op2_token_records(spark, str(tmp_path)), corpus_pipeline.token_records(spark, docs, str(tmp_path))):
        for r in found.collect():
            with open(r["path"], "rb") as file:
                file.seek(r["byte_offset"])
                assert file.read(len(r["record"])) == r["record"]


@pytest.mark.parametrize("keep_all", [False, True])
def test_mixture_meets_targets(spark, keep_all):
    rows, known = [], []
    for i in range(600):
        d = "abc"[i % 3 if i % 2 else 0]
        rows.append((i, " ".join(f"{d}{RNG.randint(0, 60)}" for _ in range(RNG.randint(5, 60)))))
        if i < 300:
            known.append((i, d))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    domains = spark.createDataFrame(known, "doc_id long, domain string")
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    fit = mixing.Fit(floor=1.0 if keep_all else 0.0, keep_all=keep_all)
    got = mixing.mixture(docs, domains, targets, fit=fit).collect()
    assert all(abs(sum(r["membership"]) - 1) < 1e-9 for r in got)
    assert sum("abc"[int(np.argmax(r["membership"]))] == rows[r["doc_id"]][1][0] for r in got) > 590
    sums = np.array([[r["rate"] * r["n_tokens"] * p for p in r["membership"]] for r in got]).sum(0)
    assert np.allclose(sums / sums.sum(), list(targets.values()), atol=0.02 if keep_all else 1e-5)
    assert min(r["rate"] for r in got) >= fit.floor
    assert all(math.floor(r["rate"]) <= r["copies"] <= math.floor(r["rate"]) + 1 for r in got)
    copies = Counter(r["doc_id"] for r in mixing.mixed(docs, domains, targets, fit=fit).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mixture_counts_tokens_and_tells_what_it_misses(spark):
    rows = [(i, f"{'ab'[i % 2]}{i % 7} 漢字かな") for i in range(200)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    domains = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "doc_id long, domain string")
    codec = token_output.encoding(mixing.Classifier.vocabulary)
    with pytest.warns(UserWarning, match="misses its targets"):
        got = mixing.mixture(docs, domains, targets := {"a": 0.2, "b": 0.3, "c": 0.5})
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {i: len(codec.encode_ordinary(t or "")) for i, t in rows}
    told = {r["domain"]: r for r in mixing.reached(got, targets).collect()}
    assert not told["c"]["met"] and told["c"]["share"] < 0.4 and told["c"]["target"] == 0.5
    assert sum(r["share"] for r in told.values()) == pytest.approx(1)
    fair = mixing.mixture(docs, domains, {"a": 0.5, "b": 0.5})
    assert all(r["met"] for r in mixing.reached(fair, {"a": 0.5, "b": 0.5}).collect())
    assert not any(r["met"] or r["share"] for r in mixing.reached(fair.limit(0), targets).collect())


def test_items_with_string_ids_in_blocks_and_of_a_least_length(spark):
    texts = ["one two three four five six seven eight nine", "yes", "ten eleven twelve thirteen", "of no id at all"]
    items = spark.createDataFrame([("q-1", texts[0]), ("q-0", texts[0]), ("x", "Yes."), ("y", texts[2]), (None, texts[3])], "item_id string, text string")
    docs = spark.createDataFrame([*enumerate(f"a {t} z" for t in texts), (9, None)], "doc_id long, text string")
    for block in (1, 6, 1_000):
        held = decontaminate.held_items(docs, items, block=block)
        got = {r["doc_id"]: [x["item_id"] for x in r["h"]] for r in docs.select("doc_id", held.alias("h")).collect()}
        assert (got[0], got[1], got[2], got[9]) == (["q-0"], ["x"], ["y"], []) and got[3][0].startswith("-")
    found = decontaminate.contaminated(docs, items, edits=decontaminate.Edits(least=2)).collect()
    assert {r["doc_id"] for r in found if r["contaminated"]} == {0, 2, 3}


def test_audit_finds_all_damage(spark):
    rows = [(RNG.randint(0, 3), i * 100, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(3000)]
    master = {(a, o): h for a, o, h in rows}
    replica, wanted = dict(master), set()
    for key in RNG.sample(sorted(master), 60):
        kind = RNG.choice(["changed", "missing", "added"])
        if kind == "changed":
            replica[key] = "0" * 64
        elif kind == "missing":
            del replica[key]
        else:
            key = (key[0], key[1] + 7)
            replica[key] = "1" * 64
        wanted.add((*key, kind))
    replica[9, 10**7] = "2" * 64  # an archive that the master lacks, far out
    wanted.add((9, 10**7, "added"))
    frames = [
        spark.createDataFrame([(a, o, h) for (a, o), h in x.items()], "archive long, offset long, sha256 string")
        for x in (master, replica)
    ]
    got = fixity.audit(*frames, width=1000, fanout=4).collect()
    assert {(r["archive"], r["offset"], r["kind"]) for r in got} == wanted and len(got) == len(wanted)
    assert not fixity.audit(frames[0], frames[0], width=1000, fanout=4).collect()


def test_warc_records_lie_end_to_end(spark):
    rows = [(i, f"http://a/{i}", text(RNG.randint(0, 30))) for i in range(50)] + [(3, None, None), (None, "u", "h"), (None, "u", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = fixity.warc_records(pages, records=10).collect()
    assert len(got) == len(rows)
    archives = defaultdict(list)
    for r in got:
        archives[r["archive"]].append((r["offset"], r["length"]))
    for records in archives.values():
        at = 0
        for offset, length in sorted(records):
            assert offset == at
            at += length
