"""Gates, citations, fingerprints and workings on planted cases and against plain versions."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.operators import citations, fingerprints, gates, routing, workings

DEVIATION = "run int, gap_id string, materiality string, disposition string, state string, rating double, considered boolean, bucket string, question string, minutes int, confidence string, open_questions array<string>, step string"
EVIDENCE = "run int, gap_id string, side string, class string, seen boolean, held boolean, standard boolean"


def deviation(gap, run=1, materiality="Medium", disposition="ADOPT", state="NOT_LOCALIZATION", rating=None, considered=None, bucket="CONFIRM", question="Keep?", minutes=5, step="1.1"):
    return (run, gap, materiality, disposition, state, rating, considered, bucket, question, minutes, "High", None, step)


def evidence(gap, side="template", kind="E1", seen=True, held=True, standard=True, run=1):
    return (run, gap, side, kind, seen, held, standard)


def gated(spark, deviations, proofs, localization=True, score_b=True):
    runs = spark.createDataFrame([(1, localization, score_b), (2, True, True)], "run int, localization boolean, score_b boolean")
    mended, issues = gates.deviation_gates(runs, spark.createDataFrame(deviations, DEVIATION), spark.createDataFrame(proofs, EVIDENCE))
    found = {}
    for r in issues.collect():
        found.setdefault(r.gap_id, []).append((r.gate, r.severity, r.rule))
    return {r.gap_id: r for r in mended.collect()}, found


BOTH = lambda gap: [evidence(gap), evidence(gap, "as_is")]


def test_each_gate_finds_its_planted_fault(spark):
    rows = [
        deviation("clean", materiality="High"), deviation("bare", materiality="Critical", question=""), deviation("one side", materiality="High"), deviation("lost", materiality="High"),
        deviation("statute", state="CONFIRMED_STATUTORY"), deviation("proved", state="CONFIRMED_STATUTORY"), deviation("build", disposition="LOCAL_EXTENSION"), deviation("weighed", disposition="LOCAL_EXTENSION", considered=True),
        deviation("rated", rating=3.0), deviation("standard", rating=3.0), deviation("fake", rating=3.0), deviation("idle", bucket="MUST_DISCUSS", question=" "), deviation("minor", bucket="MUST_DISCUSS", question=None, materiality="Low"), deviation("untimed", bucket="MUST_DISCUSS", minutes=None),
    ]
    proofs = BOTH("clean") + [evidence("one side"), evidence("lost", seen=False), evidence("lost", held=False), evidence("lost", held=None), evidence("statute", kind="E2"), evidence("statute", "sap_bp"), evidence("proved", "localization")]
    proofs += [evidence("standard", "sap_bp"), evidence("fake", "sap_bp", standard=False)]
    got, found = gated(spark, rows, proofs)
    told = lambda r: (r.disposition, r.state, r.rating, r.bucket, r.confidence, r.minutes, list(r.open_questions or []))
    same = lambda gap: told(got[gap])[:6] == ("ADOPT", "NOT_LOCALIZATION", None, "CONFIRM", "High", 5)
    assert same("clean") and "clean" not in found and same("one side") and found["one side"] == [("QG2", "soft", "one side only")]
    assert told(got["bare"]) == ("REQUIRES_DECISION", "NOT_LOCALIZATION", None, "MUST_DISCUSS", "Low", 5, [gates.ASK_EVIDENCE])
    assert found["bare"] == [("QG2", "hard", "material without evidence"), ("QG6", "hard", "nothing to decide")]
    assert told(got["lost"]) == ("REQUIRES_DECISION", "NOT_LOCALIZATION", None, "MUST_DISCUSS", "Low", 5, [gates.ASK_EVIDENCE])
    assert sorted(found["lost"]) == [("QG2", "hard", "material without evidence"), ("QG2", "hard", "not retrieved"), ("QG2", "hard", "quote absent"), ("QG2", "hard", "quote absent")]
    assert told(got["statute"]) == ("ADOPT", "SUSPECTED", None, "MUST_DISCUSS", "High", 5, [gates.ASK_STATUTE]) and found["statute"] == [("QG4", "hard", "statutory without an explicit source")]
    assert got["proved"].state == "CONFIRMED_STATUTORY" and "proved" not in found
    assert told(got["build"])[:4] == ("REQUIRES_DECISION", "NOT_LOCALIZATION", None, "MUST_DISCUSS") and got["weighed"].disposition == "LOCAL_EXTENSION" and "weighed" not in found
    assert got["rated"].rating is None and got["standard"].rating == 3.0 and got["fake"].rating is None
    assert found["fake"] == [("QG5", "hard", "rating without a source"), ("QG2", "hard", "not a standard source")]
    assert found["idle"] == [("QG6", "hard", "nothing to decide")] and got["minor"].bucket == "CONFIRM" and found["minor"] == [("QG6", "soft", "minor and undecidable")]
    assert got["untimed"].minutes == 10 and "untimed" not in found


def test_runs_without_a_country_or_a_third_side(spark):
    rows = [deviation("a", state="CONFIRMED_STATUTORY", rating=2.0), deviation("b", run=2, state="SUSPECTED")]
    got, found = gated(spark, rows, [evidence("a", "sap_bp")], localization=False, score_b=False)
    assert got["a"].state == "NOT_LOCALIZATION" and got["a"].rating is None and got["b"].state == "SUSPECTED"
    assert found == {"a": [("QG4", "soft", "localization without a country"), ("QG5", "soft", "rated against itself")]}


def test_gates_of_nothing_and_twice(spark):
    got, found = gated(spark, [], [])
    assert got == {} and found == {}
    once, _ = gated(spark, [deviation("x", materiality="High", question=None)], [])
    again, _ = gated(spark, [tuple(once["x"][c.split()[0]] for c in DEVIATION.split(", "))], [])
    assert again["x"] == once["x"]  # mended rows stay as they are


def test_rules_that_undo_each_other_are_told(spark):
    flip = [gates.Rule("A", "hard", "flip", F.col("v") >= 0, {"v": 1 - F.col("v")})]
    with pytest.raises(RuntimeError, match="undo"):
        gates.enforced(spark.createDataFrame([(0,)], "v int"), flip, passes=3)


def test_gates_of_runs(spark):
    df = spark.createDataFrame
    runs = df([(1, False, " "), (2, True, ""), (3, False, "Order to cash"), (4, None, None)], "run int, scope_named boolean, template_process string")
    deviations, fits = df([(1, "g1", "5.1, 5.14 and 6")], "run int, gap_id string, step string"), df([(1, "7a")], "run int, step string")
    steps = df([(1, "5.1"), (1, "5.14"), (1, "6"), (1, "7A"), (2, "5.1")], "run int, step string")
    backlog = df([(1, "g1", "t"), (2, "g1", "u"), (1, None, "v")], "run int, gap_id string, title string")
    mended, kept, issues = gates.run_gates(runs, deviations, fits, steps, backlog)
    assert {r.run: r.template_process for r in mended.collect()} == {1: gates.UNNAMED, 2: "", 3: "Order to cash", 4: gates.UNNAMED}
    assert [r.title for r in kept.collect()] == ["t"]
    assert sorted((r.run, str(r.gap_id), r.gate, r.rule) for r in issues.collect()) == [
        (1, "None", "QG7", "backlog without a gap"), (1, "None", "QG7", "no baseline named"), (2, "None", "QG1", "steps not mapped"), (2, "g1", "QG7", "backlog without a gap"), (4, "None", "QG7", "no baseline named")]


MOVES = {"PKG:1": "PKG:10", "PKG:10": "PKG:1", "A_2:7": "A_2:8", "Z:1": "Z:1"}


def plain(value, copied=False, name=None):
    """The rule on parsed JSON, one value at a time."""
    if isinstance(value, dict):
        return {MOVES.get(k, k): plain(v, copied or k in citations.COPIED, k) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v, copied) for v in value]
    if not isinstance(value, str):
        return value
    if name == "chunk_id":
        return MOVES.get(value, value)
    return value if copied else re.sub(r"\b[A-Z][A-Z0-9_]*:\d+\b", lambda m: MOVES.get(m[0], m[0]), value, flags=re.ASCII)


words = st.sampled_from(["see PKG:1 and (PKG:10)", "PKG:1", "XPKG:1 PKG:1x", 'quoted \\"PKG:1\\"', "A_2:7, Z:1", "[{PKG:1}]", "", "é PKG:10é", "back\\slash PKG:1\\"])
names = st.sampled_from(["note", "chunk_id", "quote", "sources", "PKG:1", "A_2:7", "markdown", "items", "PKG:99"])
answers = st.recursive(words | st.integers() | st.none() | st.booleans(), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(names, inner, max_size=4), max_leaves=14)


@settings(max_examples=500, deadline=None)
@given(answers, st.sampled_from([None, 1]), st.booleans())
def test_citations_follow_in_ids_keys_and_prose_only(answer, indent, escaped):
    text = json.dumps(answer, indent=indent, ensure_ascii=escaped)
    got = citations.rewritten(text, MOVES.get)
    # keys that move onto another key of the same map are both there, as in the text
    pairs = lambda t: json.loads(t, object_pairs_hook=lambda p: [list(x) for x in p])

    def listed(value, copied=False, name=None):
        if isinstance(value, dict):
            return [[MOVES.get(k, k), listed(v, copied or k in citations.COPIED, k)] for k, v in value.items()]
        return [listed(v, copied) for v in value] if isinstance(value, list) else plain(value, copied, name)

    assert pairs(got) == listed(answer)


def test_answers_look_up_their_own_tokens(spark):
    rows = [(1, '{"chunk_id": "PKG:1", "quote": "PKG:1", "note": "PKG:10 PKG:77"}'), (2, None), (3, "not json PKG:1"), (4, "{}"), (5, '{"quote": "PKG:1"}')]
    moves = spark.createDataFrame(list(MOVES.items()), "old string, new string")
    got = {r.id: (r.text, r.moved) for r in citations.remap_citations(spark.createDataFrame(rows, "id int, text string"), moves, "id", "text").collect()}
    assert got == {1: ('{"chunk_id": "PKG:10", "quote": "PKG:1", "note": "PKG:1 PKG:77"}', 2), 2: (None, 0), 3: ("not json PKG:1", 0), 4: ("{}", 0), 5: ('{"quote": "PKG:1"}', 0)}


INPUT = "kind string, category string, key string, fingerprint string"


def test_one_changed_row_names_one_branch(spark):
    rows = [("corpus", f"c{i % 3}", f"k{i}", f"f{i}") for i in range(200)] + [("register", "r", "k", None), ("register", None, None, "f"), ("corpus", "c0", "k0", "f0")]
    df = lambda r: spark.createDataFrame(r, INPUT)
    was = fingerprints.tree(df(rows))
    assert sorted(map(tuple, was.collect())) == sorted(map(tuple, fingerprints.tree(df(rows[::-1]).repartition(7)).collect()))
    assert {(r.level, r.branch): r.n for r in was.collect()} == {(0, ""): 203, (1, "corpus"): 201, (1, "register"): 2, (2, "corpus/c0"): 68, (2, "corpus/c1"): 67, (2, "corpus/c2"): 66, (2, "register/r"): 1, (2, "register/"): 1}
    now = [("corpus", "c1", "k1", "new") if r[2] == "k1" else r for r in rows]
    differing = fingerprints.changed(was, fingerprints.tree(df(now)))
    assert sorted(map(tuple, differing.collect())) == [(0, "", "differs"), (1, "corpus", "differs"), (2, "corpus/c1", "differs")]
    assert [tuple(r) for r in fingerprints.changed_inputs(df(rows), df(now), differing).collect()] == [("corpus", "c1", "k1", "differs")]
    gone = [r for r in rows if r[1] != "r"] + [("other", "o", "k", "f")]
    assert sorted(map(tuple, fingerprints.changed(was, fingerprints.tree(df(gone))).collect())) == [(0, "", "differs"), (1, "other", "came"), (1, "register", "differs"), (2, "other/o", "came"), (2, "register/r", "went")]
    for fp in ("", "-", "="):  # null is no text
        assert fingerprints.changed(fingerprints.tree(df([("a", "b", "k", None)])), fingerprints.tree(df([("a", "b", "k", fp)]))).count() == 3


def test_a_cache_is_served_while_its_sources_stand(spark):
    now = fingerprints.tree(spark.createDataFrame([("a", "b", "k", "f")], INPUT))
    root = now.filter("level = 0").first().digest
    of = lambda d: fingerprints.served(spark.createDataFrame([(d,)] if d else [], "built_from string"), now).first().fresh
    assert (of(root), of("x" * 64), of(None)) == (True, False, False)
    assert fingerprints.tree(spark.createDataFrame([], INPUT)).first().n == 0


def test_workings_of_all_shapes(spark):
    calls = [
        (1, 2, "NLIStatementOutput", '{"statements": [{"statement": "c", "verdict": "1", "reason": null}, {"statement": "d"}]}', 1), (1, 1, "NLIStatementOutput", '[{"statements": [{"statement": "a", "verdict": 1, "reason": "r"}, {"statement": "b", "verdict": 0}]}, {"statements": []}]', 1), (1, 3, "ContextPrecisionOutput", '{"verdict": 1}', 1),
        (2, 9, "ContextPrecisionOutput", '{"verdict": false, "reason": "no"}', 2), (2, 5, "ContextPrecisionOutput", '{"verdict": true}', 2), (3, 1, "ContextPrecisionOutput", '{"verdict": 1}', 2),
        (4, 1, "AnswerRelevanceOutput", '{"question": "why?", "noncommittal": 0}', 0), (5, 1, "ContextRelevanceOutput", '{"rating": 2}', 0), (5, 2, "ContextRelevanceOutput", '{"rating": 9}', 0), (5, 3, "ContextRelevanceOutput", "{}", 0),
        (6, 1, "NLIStatementOutput", "no json", 0), (6, 2, "AnswerRelevanceOutput", '{"question": 7}', 0), (7, 1, "Other", "{}", 0), (8, 1, "NLIStatementOutput", None, 0), (9, 1, "NLIStatementOutput", '{"other": 1}', 0),
    ]
    got = {}
    for r in workings.items(spark.createDataFrame(calls, "run int, at int, model string, answer string, contexts int"), "run").orderBy("run", "place").collect():
        got.setdefault(r.run, []).append((r.kind, r.n, r.text, r.flag, r.reason, r.rating, r.label))
    assert got == {
        1: [("claims", i + 1, t, f, w, None, None) for i, (t, f, w) in enumerate([("a", True, "r"), ("b", False, None), ("c", True, None), ("d", False, None)])],
        2: [("excerpts", 1, None, True, None, None, None), ("excerpts", 2, None, False, "no", None, None)], 3: [("excerpts", None, None, True, None, None, None)],
        4: [("questions", 1, "why?", False, None, None, None)], 5: [("ratings", 1, None, None, None, 2, "relevant"), ("ratings", 2, None, None, None, 9, "unrated"), ("ratings", 3, None, None, None, None, "unrated")],
        6: [("questions", 1, "7", False, None, None, None)],
    }
    told = workings.workings(spark.createDataFrame(calls[:2], "run int, at int, model string, answer string, contexts int"), "run").first()
    assert json.loads(told.working)["kind"] == "claims" and [i["text"] for i in json.loads(told.working)["items"]] == ["a", "b", "c", "d"]


def longest_first(words, names):
    """Left to right, the longest name at each place."""
    out, at = [], 0
    while at < len(words):
        n = max((n for n in range(1, len(words) - at + 1) if " ".join(words[at : at + n]) in names), default=0)
        if n:
            out.append((at + 1, n, names[" ".join(words[at : at + n])]))
        at += n or 1
    return out


def test_anchors_and_routes_equal_a_plain_reading(spark):
    import random

    rng = random.Random(4)
    nodes = [("n1", "alpha", None), ("n2", "Alpha Beta", "A-1"), ("n3", "beta gamma", None), ("n4", "gamma", "b"), ("n5", "alpha", None), ("n6", None, None), ("n7", "...", "delta delta delta")]
    names = {"alpha": "n1", "alpha beta": "n2", "a 1": "n2", "beta gamma": "n3", "gamma": "n4", "b": "n4", "delta delta delta": "n7"}
    vocabulary = ["alpha", "beta", "Gamma", "delta", "A-1", "b", "documents", "path", "x", "connection", "spec"]
    questions = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for i in range(300)] + [(300, None), (301, "?!"), (302, "alpha -> gamma"), (303, "alpha alpha"), (304, "compare alpha with alpha")]
    held = routing.names_of(spark.createDataFrame(nodes, "id string, label string, code string"), ["label", "code"])
    asked = spark.createDataFrame(questions, "query_id int, text string")
    found = {}
    for r in routing.anchors(asked, held).collect():
        found.setdefault(r.query_id, []).append((r.at, r.words, r.node))
    got = {r.query_id: r for r in routing.routed(asked, held, most=3).collect()}
    assert len(got) == len(questions)
    for i, text in questions:
        low = (text or "").lower()
        words = re.findall(r"[^\W_]+", low)
        want = longest_first(words, names)
        assert sorted(found.get(i, [])) == want
        different = list(dict.fromkeys(n for _, _, n in want))[:3]
        kind = next((k for k, said in routing.TYPE_WORDS.items() if set(words) & set(said)), None)
        cue = re.search(routing.PATH_CUES, low)
        route = "path" if cue and len(different) > 1 else "two hops" if different and kind else "neighbourhood" if different else "global"
        assert (got[i].route, list(got[i].anchors), got[i].wanted) == (route, different, kind)
        assert got[i].target == (different[1] if route == "path" else None) and got[i].source == (different[0] if different else None)


def test_routes_without_names(spark):
    none = spark.createDataFrame([], "id string, label string")
    got = routing.routed(spark.createDataFrame([(1, "path between a and b")], "query_id int, text string"), routing.names_of(none, ["label"])).collect()
    assert [(r.route, r.anchors) for r in got] == [("global", [])]


def test_many_paths_at_once(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("a", "c")]
    pairs = [(1, "a", "e"), (2, "e", "a"), (3, "a", "x"), (4, "a", "a"), (5, "b", "d"), (6, "x", "y")]
    df = spark.createDataFrame
    got = routing.path_lengths(df(pairs, "query_id int, source string, target string"), df(edges, "source string, target string")).collect()
    assert {r.query_id: r.hops for r in got} == {1: 3, 2: 3, 4: 0, 5: 2, 6: 1}
    near = routing.path_lengths(df(pairs, "query_id int, source string, target string"), df(edges, "source string, target string"), most=2).collect()
    assert {r.query_id for r in near} == {4, 5, 6}
