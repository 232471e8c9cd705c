"""Operators on pairs and windows, against brute force."""

import itertools
import json
import random

import numpy as np
from conftest_llm import prose

from phonoweave.llm import chat, decontaminate, jaccard_join, licenses, vector_dedup
from phonoweave.llm.common import Scratch
from phonoweave.llm.components import components


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingle_list(text, size):
    w = words(text)
    return [tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []


def roots(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_copies(seed, base, n, changes):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randrange(changes + 1)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["new"], [w[k], "more"]])
        out.append(" ".join(w))
    return out


def check_jaccard(make, rows, size=4, percent=85):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(make(rows), percent, size).collect()}
    sets = {d: set(shingle_list(t, size)) for d, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    component = roots(sets, links)
    assert got == {d: (len(s), component[d]) for d, s in sets.items()}
    return links


def test_jaccard_join_is_exact(make, monkeypatch):
    rows = [(k, prose(k, 30 + k % 60)) for k in range(60)]
    for g, base in enumerate((prose(500, 25), prose(501, 90), prose(502, 12), prose(503, 16), prose(504, 9))):
        rows += [(1000 + 100 * g + k, t) for k, t in enumerate(near_copies(g, base, 40, 3))]
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "one two"), (5004, "ONE  two\n"), (5005, "one two three"), (5006, " \t")]
    random.Random(1).shuffle(rows)
    links = check_jaccard(make, rows)
    assert len(links) > 300
    monkeypatch.setattr(jaccard_join, "LIGHT", 3)
    check_jaccard(make, rows)
    monkeypatch.setattr(jaccard_join, "ELEMENTS", 150)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 5)
    check_jaccard(make, rows)
    check_jaccard(make, rows, 5, 80)


def test_jaccard_join_awkward(make, awkward):
    rows = jaccard_join.jaccard_components(make(awkward)).collect()
    assert len(rows) == len(awkward)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[4].component_id == by[5].component_id == 4
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[6].n_shingles == 1
    assert jaccard_join.jaccard_components(make([])).count() == 0


def test_jaccard_join_takes_keys_and_families_some_at_a_time(make, monkeypatch):
    monkeypatch.setattr(jaccard_join, "KEYS_AT_ONCE", 300)
    monkeypatch.setattr(jaccard_join, "CLASSES_AT_ONCE", 20)
    taken, verified = [], jaccard_join._verified

    def counted(texts, repeated, members, *more):
        taken.append(members.count())
        return verified(texts, repeated, members, *more)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    texts = [t for k in range(12) for t in near_copies(300 + k, prose(300 + k, 25 + 6 * k), 5, 2)]
    rows = [*enumerate(texts), (500, "a b c"), (501, "A b C"), (502, None)]
    assert check_jaccard(lambda r: make(r), rows)
    assert len(taken) > 1 and max(taken) < sum(taken)


def test_near_duplicates_leave_without_a_shuffle_of_the_texts(spark, make):
    import corpus_pipeline

    rows = [(k, prose(k, 30)) for k in range(20)] + [(100, prose(3, 30)), (101, " ")]
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_duplicate_stage(spark, make(rows), "")
        assert sorted(x.doc_id for x in kept.collect()) == [*range(20), 101]
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_jaccard_join_links_through_rows_without_an_id(spark, make):
    import corpus_pipeline

    base = prose(77, 60).split()
    left, right = " ".join(["new", *base[1:-3]]), " ".join([*base[4:-1], "new"])
    middle = " ".join(base[2:-2])
    sets = [set(shingle_list(t, 5)) for t in (left, middle, right)]
    near = [100 * len(a & b) >= 88 * len(a | b) for a, b in ((sets[0], sets[1]), (sets[1], sets[2]), (sets[0], sets[2]))]
    assert near == [True, True, False]
    other, alone = prose(78, 60), prose(79, 60)
    rows = [(1, left), (None, middle), (None, middle), (2, right), (None, other), (None, other + " more"), (None, other), (3, alone), (3, prose(80, 60)), (3, alone), (5, prose(80, 60)), (None, alone + " x"), (6, None), (None, None), (None, " ")]
    got = jaccard_join.jaccard_components(make(rows), 88, 5).collect()
    assert sorted(x.component_id for x in got if x.doc_id in (1, 2)) == [1, 1] and [x.component_id for x in got if x.doc_id == 5] == [3]
    corpus_percent, corpus_pipeline.PERCENT = corpus_pipeline.PERCENT, 88
    try:
        kept = corpus_pipeline.near_duplicate_stage(spark, make(rows), "").select("doc_id", "text").collect()
    finally:
        corpus_pipeline.PERCENT = corpus_percent
    texts = sorted([tuple(x) for x in kept], key=str)
    of_other = [t for t in texts if t[1] and t[1].startswith(other)]
    assert len(of_other) == 1 and of_other[0][0] is None
    assert [t for t in texts if t not in of_other] == sorted([(1, left), (3, alone), (3, prose(80, 60)), (6, None), (None, None), (None, " ")], key=str)


def test_enumeration_reaches_all_links_of_small_sets():
    for percent in (80, 85):
        most = jaccard_join.most_enumerated(percent)
        assert most >= 13
        for n in range(1, most + 1):
            for m, overlap, out in jaccard_join.subsets(n, most, percent):
                assert out == n - overlap and 100 * overlap >= percent * (n + m - overlap) and 100 * (overlap - 1) < percent * (n + m - overlap + 1)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(600, k) for k in range(601, 700)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    want = roots({i for e in edges for i in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_vector_dedup(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = r.normal(size=(30, 16))
    rows = []
    for k in range(400):
        v = base[k % 30] + r.normal(size=16) * (0.02 if k % 3 else 0.15)
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 2))
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, rows[0][1], None), (2004, rows[0][1][:8], 0), (2005, [None] + [1.0] * 15, 1), (2006, [], 1), (2007, [float(x) * 3 for x in np.float32(rows[0][1])], 0)]
    monkeypatch.setattr(vector_dedup.vector_links, "__defaults__", (vector_dedup.THRESHOLD, 8))
    monkeypatch.setattr(vector_dedup, "CROWDED", 1)
    monkeypatch.setattr(vector_dedup, "PARTNERS", 3)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n_links", "2 AS id", "3 AS key")
    got = {x.vec_id: x for x in vector_dedup.vector_components(frame).collect()}
    usable = {i: (l, np.array(np.float32(v), float)) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a, b in itertools.combinations(usable, 2) if usable[a][0] == usable[b][0] and len(usable[a][1]) == len(usable[b][1]) and usable[a][1] @ usable[b][1] / np.linalg.norm(usable[a][1]) / np.linalg.norm(usable[b][1]) >= 0.98]
    component = roots([i for i, _, _ in rows], links)
    for i, _, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in e for e in links), component[i], component[i] == i)
    assert len(links) > 500 and vector_dedup.vector_components(frame.limit(0)).count() == 0


def best_windows(rows, items, similarity=0.8):
    found = {}
    for doc, text in rows:
        w = words(text)
        for item, item_text in items:
            want = shingle_list(item_text, 5)
            n = len(words(item_text))
            if not want or not w:
                continue
            for at in range(max(1, len(w) - n + 1)):
                have = shingle_list(" ".join(w[at : at + n]), 5)
                least = sum(min(have.count(s), want.count(s)) for s in set(have))
                score = least / (len(have) + len(want) - least)
                if score >= similarity and score > found.get((doc, item), (0,))[0]:
                    found[doc, item] = (score, at)
    return found


def test_decontamination(spark, make, awkward):
    items = [(k, prose(900 + k, 14 + 3 * k)) for k in range(8)] + [(100, None), (101, ""), (102, "two words"), (103, prose(903, 40))]
    rows = list(awkward)
    for k in range(8):
        body = prose(50 + k, 60).split()
        rows.append((100 + k, " ".join(body[:20]) + "\n" + items[k][1].upper() + " " + " ".join(body[20:])))
        near = items[k][1].split()
        near[2] = "changed"
        rows.append((200 + k, " ".join(body[:7] + near + body[7:])))
        rows.append((300 + k, " ".join(items[k][1].split()[: len(near) // 2]) + " " + " ".join(body)))
    rows.append((400, "two words"))
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS n")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.contaminated(make(rows), benchmark).collect()}
    want = best_windows([r for r in rows if r[0] is not None], items)
    assert {k: v[0] for k, v in got.items()} == {k: round(v[0], 6) for k, v in want.items()}
    assert all((100 + k, k) in got for k in range(8)) and (400, 102) in got and not any(d is not None and 300 <= d < 400 for d, _ in got)
    assert decontaminate.contaminated(make([]), benchmark).count() == decontaminate.contaminated(make(rows), benchmark.limit(0)).count() == 0


def test_null_ids_are_searched(spark, make, awkward, tmp_path):
    import corpus_pipeline

    items = [(k, prose(900 + k, 14 + 3 * k)) for k in range(3)]
    leaks = [(None, prose(1, 30) + " " + items[0][1]), (None, items[1][1] + " " + prose(2, 30)), (7000, items[2][1]), (7001, prose(3, 20) + " " + items[0][1])]
    clean = [(None, prose(4, 50)), (7001, prose(5, 50)), (7002, prose(6, 50))]
    rows = [*awkward, *leaks, *clean]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.contaminated(make(rows), benchmark).collect()}
    assert got == {k: (round(v[0], 6), v[1]) for k, v in best_windows(rows, items).items()} and (None, 0) in got and (None, 1) in got
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.decontaminate_stage(spark, make(rows), str(tmp_path))
    assert kept.columns == make(rows).columns
    assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted(make([*awkward, *clean]).select("doc_id", "text").collect(), key=str)
    notice = dict(licenses.TEMPLATES)["MPL-2.0"]
    found = {(r.doc_id, r.license_id): r.start for r in licenses.license_scan(make([*clean, (None, prose(1, 40) + " " + notice), (8, notice)])).collect()}
    assert set(found) == {(None, "MPL-2.0"), (8, "MPL-2.0")}


def test_pipeline_against_brute_force(spark, make, awkward, tmp_path):
    """All stages over rows with null and repeated ids, blank texts, copies, leaks and extra columns; the classifier's scores
    are taken as they are, what the stages do with them and all others by brute force."""
    import hashlib

    import corpus_pipeline
    import tiktoken
    import public_tokenizers
    from tiktoken.load import load_tiktoken_bpe

    from phonoweave.llm import quality

    r = random.Random(3)
    good = [(k, prose(k, 40)) for k in range(60)]
    bad = [(1000 + k, " ".join(r.choice(["buy", "now", "cheap", "!!!", "click"]) for _ in range(40))) for k in range(60)]
    items = [(k, prose(900 + k, 20)) for k in range(3)]
    copies = [(2000 + k, t) for k, t in enumerate(near_copies(9, prose(700, 70), 12, 4))] + [(5, good[5][1]), (None, good[6][1]), (None, good[6][1])]
    leaks = [(3000 + k, prose(40 + k, 20) + " " + t) for k, t in items] + [(None, prose(30, 20) + " " + items[0][1]), (3000, prose(31, 30))]
    rows = [*good, *bad, *copies, *leaks, *awkward]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)] + [(1000 + k, 0, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    pairs = lambda df: sorted(((x.doc_id, x.text) for x in df.select("doc_id", "text").collect()), key=str)

    docs, names = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    accepted = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    scored = quality.fit_and_score(docs, labels, threshold=0.3).collect()
    chosen = pairs(accepted)
    assert len(chosen) == sum(x.predicted for x in scored) and not any(t in dict(bad).values() for _, t in chosen) and set(good) <= set(chosen)

    once = corpus_pipeline.near_duplicate_stage(spark, accepted, str(tmp_path))
    sets = [set(shingle_list(t, 5)) for _, t in chosen]
    component = roots(range(len(chosen)), [(a, b) for a, b in itertools.combinations(range(len(chosen)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    groups = {}
    for k, (d, t) in enumerate(chosen):
        groups.setdefault((component[k],) if sets[k] else (component[k], k), []).append((d is None, d or 0, t))
    first = sorted(min(g)[:2] for g in groups.values())
    kept = pairs(once)
    assert sorted((d is None, d or 0) for d, _ in kept) == first and set(kept) <= set(chosen)

    clean = corpus_pipeline.decontaminate_stage(spark, once, str(tmp_path))
    leaked = {t for k, (_, t) in enumerate(kept) if best_windows([(k, t)], items)}
    assert pairs(clean) == [x for x in kept if x[1] not in leaked] and len(leaked) >= 3
    for frame in (accepted, once, clean):
        assert frame.columns == docs.columns

    encoding = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = [(d, hashlib.sha256(",".join(map(str, encoding.encode_ordinary(t or ""))).encode()).hexdigest()) for d, t in pairs(clean)]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((x.doc_id, x.ids_sha256) for x in got.collect()), key=str) == sorted(want, key=str)
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))


def test_licenses(make, awkward):
    def shingles(text):
        import regex

        w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
        return w

    rows = list(awkward)
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        rows.append((100 + k, prose(k, 17 + 5 * k) + "\n" + text + "\n" + prose(60 + k, 40)))
        rows.append((200 + k, text.upper().replace(" ", "\n  ")))
    rows.append((300, "Licensed under the"))
    got = {(r.doc_id, r.license_id): r.containment for r in licenses.license_scan(make(rows)).collect()}
    want = {}
    for doc, text in rows:
        w = shingles(text or "")
        for license_id, template in licenses.TEMPLATES:
            t = shingles(template)
            size = licenses.window_class(len(t))
            wanted = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
            starts = {max(0, min(s, len(w) - size)) for s in range(0, max(1, len(w)), size // 2)}
            for at in starts:
                window = w[at : at + size]
                share = len(wanted & {tuple(window[k : k + 5]) for k in range(len(window) - 4)}) / len(wanted)
                if share >= 0.8:
                    want[doc, license_id] = max(want.get((doc, license_id), 0), round(share, 6))
    assert got == want
    assert all((100 + k, i) in got and (200 + k, i) in got for k, (i, _) in enumerate(licenses.TEMPLATES))
    assert licenses.license_scan(make([])).count() == 0


def test_band_settings():
    for m in range(5, 120):
        w = licenses.window_class(m)
        t = m - 4
        need = -(-8 * t // 10)
        jaccard = need / (w - 4 + t - need)
        assert w >= 2 * m and (1 - jaccard) ** licenses.bands(w, t) <= 1e-6 * 1.01


def test_chat(spark):
    call = lambda *c: json.dumps({"tool_calls": list(c)})
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call({"id": "a", "name": "f", "arguments": {"z": 1, "b": "x"}}, {"id": "b", "name": "f", "arguments": {"b": 2}, "depends_on": ["a"]}, {"id": "c", "name": "f", "arguments": {"q": 1}, "depends_on": ["b", "zz"]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "rb"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "ra"})),
        (1, 5, "tool", json.dumps({"tool_call_id": "a", "content": "later"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "nope", "content": "r"})),
        (2, 0, "assistant", call({"id": "x", "name": "g", "arguments": {}, "depends_on": ["y"]}, {"id": "y", "name": "g", "arguments": [1], "depends_on": ["x"]}, {"id": "w", "name": "?", "arguments": {}})),
        (2, None, None, None), (None, 0, "user", 'q"\n'), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 1, "user", "u"), (3, 2, "assistant", '{"bad'),
    ]
    tools = spark.createDataFrame([("f", "b", "string", True), ("f", "z", "integer", False), ("g", "k", "string", False), chat.RESPOND], "name string, parameter string, type string, required boolean")
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS id", "2 AS status", "3 AS place")
    got = chat.link_calls(messages, tools).collect()
    assert len(got) == len(rows) + 4
    by = {(r.conv_id, r.turn, r.kind, r.id): r for r in got}
    assert by[1, 1, "call", "a"].status == "linked" and by[1, 1, "call", "a"].problems == ""
    assert by[1, 1, "call", "a"].json == '{"arguments":{"b":"x","z":1},"id":"a","name":"f","role":"assistant","type":"call"}'
    assert by[1, 1, "call", "b"].problems == "type b" and by[1, 1, "call", "c"].problems == "missing b; unknown q"
    assert by[1, 1, "call", "c"].depends == "missing" and by[1, 1, "call", "c"].status == "unanswered"
    assert by[1, 5, "result", "a"].status == "duplicate" and by[1, 4, "result", "nope"].status == "orphan"
    assert by[2, 0, "call", "x"].depends == by[2, 0, "call", "y"].depends == "cycle"
    assert by[2, 0, "call", "w"].problems == "unknown tool" and by[2, 0, "call", "y"].problems == "arguments are no object"
    assert by[3, 2, "result", "turn:1"].status == "linked"
    order = [(r.kind, r.id) for r in sorted((r for r in got if r.conv_id == 1 and r.status == "linked"), key=lambda r: (r.order_turn, r.order_depth, r.turn, r.place))]
    assert order == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b")]
    assert chat.link_calls(messages.limit(0), tools).count() == 0


def test_chat_without_parameters_ids_or_a_clean_start(spark):
    rows = [(1, 0, "assistant", ' \n{"tool_calls":[{"id":"a","name":"now","arguments":{}},{"name":"now","arguments":{"x":1}}]}'), (1, 1, "tool", '\t{"tool_call_id":"a","content":"r"}')]
    tools = spark.createDataFrame([("now", None, None, None), (None, "p", "string", True)], "name string, parameter string, type string, required boolean")
    got = chat.link_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).orderBy("turn", "place").collect()
    assert [(r.kind, r.id, r.status, r.problems) for r in got] == [("call", "a", "linked", ""), ("call", None, "no identifier", "unknown x"), ("result", "a", "linked", "")]
    assert got[1].json == '{"arguments":{"x":1},"id":null,"name":"now","role":"assistant","type":"call"}'
