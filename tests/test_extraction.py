"""Extraction, entry checks and quotes on hand-made rows and against plain versions."""

import difflib
import random
import unicodedata

from pyspark.sql import functions as F

from quillmesh.functions.scalar import normal_text
from quillmesh.operators import catalog, entries, extraction


def test_codes_are_not_cut_out_of_longer_ones(spark):
    docs = spark.createDataFrame([(1, "INT-P-080-160, P-080-160\nx OM-20-30-40."), (2, None), (3, "")], "id int, text string")
    got = {(r.id, r.code, r.mentions) for r in extraction.codes(docs, "id", "text").collect()}
    assert got == {(1, "P-080-160", 1), (1, "OM-20-30-40", 1)}


def test_tickets_by_text_and_file_name(spark):
    docs = spark.createDataFrame([(1, "FS ABC -22234- x.md", "see abc_22234, ABC-1111 and ABC-9999"), (2, None, None)], "id int, name string, text string")
    keys = spark.createDataFrame([("ABC-9999",)], "key string")
    got = {(r.ticket, r.mentions, r.relation) for r in extraction.tickets(docs, "id", "text", "name", "ABC", keys).collect()}
    assert got == {("ABC-22234", 1, "implements"), ("ABC-1111", 1, "refers to")}


def test_descriptions_take_the_name_then_the_line_then_a_default(spark):
    docs = spark.createDataFrame([(1, "DM-270-030-010 other\n| DM-270-030 | \n# DM-270-030: Check stock | col\nOM-10-20")], "id int, text string")
    official = spark.createDataFrame([("DM-270-030-010", "Named")], "code string, name string")
    got = {r.code: r.description for r in extraction.code_descriptions(docs, "id", "text", official).collect()}
    assert got == {"DM-270-030-010": "Named", "DM-270-030": "Check stock", "OM-10-20": "Process step OM-10-20"}


def test_first_spelling_of_a_step_wins(spark):
    lines = [(1, "| 03. Lead to Cash | 4.5 A | 4.5.1 B | 4.5.1.2 First | KEY-7 |"), (2, "| 03. Lead to Cash | 4.5 A | 4.5.1 B | 4.5.1.2 Second | KEY-8 |"), (3, "| head | row |"), (4, None)]
    rows = extraction.register_rows(spark.createDataFrame(lines, "n int, line string"), "line", "n", "KEY")
    assert rows.count() == 2
    assert [tuple(r) for r in extraction.register_steps(rows, "lead to cash", "n").collect()] == [("4.5.1.2", "First", "KEY-7")]


def test_longest_common_run_is_that_of_difflib():
    rng = random.Random(3)
    for _ in range(60):
        q, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, n))) for n in (12, 40))
        longest = difflib.SequenceMatcher(None, q, t, autojunk=False).find_longest_match(0, len(q), 0, len(t)).size
        for at in range(len(q)):
            for size in range(1, len(q) - at + 1):
                runs = [n for a in range(at + 1) for n in range(at + size - a, len(q) - a + 1) if q[a : a + n] in t]
                assert entries.covering_run(q, at, size, t) == max(runs, default=0) <= longest


def test_partial_quotes_against_all_pairs(spark):
    """Every share from none to all, short items, repeated rows and nulls."""
    rng = random.Random(5)
    words = ["alpha", "be", "gamma", "delta", "of", "the", "ε", "zz"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 6, 12, 30])))) for i in range(40)] + [(40, "a"), (41, "ab"), (42, ""), (43, None), (44, "x" * 30)]
    docs = [(100 + i, " ".join(rng.choice(words) for _ in range(5)) + " " + t[: rng.randint(0, len(t))] + " — End") for i, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (202, "a"), (202, "a")]
    a, b = spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")
    got = {(r.item_id, r.doc_id): (r.share, r.status) for r in entries.partial_quotes(a, b).collect()}
    plain = lambda df, k: [(r[0], r[1]) for r in df.select(k, normal_text(F.col("text"))).collect() if r[1]]
    want = {}
    for i, q in plain(a, "item_id"):
        for j, t in plain(b, "doc_id"):
            share = round(difflib.SequenceMatcher(None, q, t, autojunk=False).find_longest_match(0, len(q), 0, len(t)).size / len(q), 2)
            if share >= 0.6:
                want[i, j] = (share, "verbatim" if q in t else "partial")
    assert got == want and {s for _, s in want.values()} == {"verbatim", "partial"}


def test_one_character_less_is_not_verbatim(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(400)).strip() + " end"
    docs = spark.createDataFrame([(1, long), (2, long[:-1] + "x"), (3, "y" + long[1:]), (4, "no")], "doc_id int, text string")
    got = {r.doc_id: (r.share, r.status) for r in entries.partial_quotes(spark.createDataFrame([(0, long)], "item_id int, text string"), docs).collect()}
    assert got == {1: (1.0, "verbatim"), 2: (1.0, "partial"), 3: (1.0, "partial")}


def test_partial_quotes_query_finds_every_verbatim_passage(spark, data):
    import __spark_entry__ as entry

    q = entry.queries()
    held = q["quote_verbatim"](spark, data).agg(F.sum("documents")).first()[0]
    rows = q["partial_quotes"](spark, data)
    assert rows.filter("status = 'verbatim'").count() >= held > 0


def test_strict_quotes(spark):
    text = unicodedata.normalize("NFC", "The “café” — open | all day")
    rows = [("the \"café\" - open", True), ("café open all day", True), ("open all night", False), ("", False), (" # ", False), (None, False)]
    df = spark.createDataFrame([(q, text, w) for q, w in rows] + [("x", None, False)], "q string, t string, want boolean")
    got = df.select("want", entries.holds_quote(entries.decomposed("q"), entries.decomposed("t")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_strict_quotes_query_holds_each_first_line(spark, data):
    import __spark_entry__ as entry

    rows = entry.queries()["strict_quotes"](spark, data).collect()
    assert rows
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text is not None}
    for r in rows:
        first = unicodedata.normalize("NFKD", docs[r.doc_id]).split("\n")[0]
        assert r.here == any(c.isalnum() or c == "_" for c in first), r.doc_id


def test_entries_without_evidence_are_unknown(spark):
    e = spark.createDataFrame([(1, "FIT", 0.9, 0.9, True), (2, "FIT", 0.9, 0.9, True), (3, "X", 0.3, None, False)], "k int, classification string, confidence double, expected double, code_known boolean")
    ev = spark.createDataFrame([(1, False), (1, None), (2, True), (3, True), (3, True)], "k int, found boolean")
    got = {r.k: (r.classification, r.confidence, r.evidence, r.issues) for r in entries.verify_entries(e, ev, "k", ["FIT"]).collect()}
    assert got[1] == ("UNKNOWN", 0.0, 0, ["not retrieved", "quote absent", "no evidence left", "confidence drifts"])
    assert got[2] == ("FIT", 0.65, 1, ["one source"])
    assert got[3] == ("X", 0.3, 2, ["code unknown", "class not allowed"])


def test_an_old_comment_counts_only_where_its_option_was_offered(spark):
    rows = [("Option B: wait", 1, "wait", ""), ("Option A: wait", None, "", "Option A: wait"), (" free text ", None, "", "free text"), (None, None, "", "")]
    df = spark.createDataFrame([r[:1] for r in rows], "c string")
    c = entries.legacy_choice(F.col("c"), F.array(F.lit("go"), F.lit("wait")))
    got = [tuple(r) for r in df.select(*(v.alias(k) for k, v in c.items())).collect()]
    assert got == [r[1:] for r in rows]


def test_named_deletion_stops_at_shared_names(spark):
    docs = spark.createDataFrame([("a/x.md",), ("b/x.md",), ("y.md",), ("a/zy.md",)], "source string")
    targets = spark.createDataFrame([("x.md",), ("y.md",), ("q.md",)], "name string")
    got = {(r.name, r.matches, r.status) for r in catalog.named_deletion(docs, targets, "source", "name").collect()}
    assert got == {("x.md", 2, "ambiguous"), ("y.md", 1, "deleted"), ("q.md", 0, "none")}


def test_declaring_a_category_twice_is_as_good_as_once(spark):
    texts = ["body", "---\ntitle: x\n---\nbody\ncategory: no", "---\nCategory: OLD\ntitle: x\n---\nbody", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = catalog.declare(F.col("t"), F.lit("NEW"))
    rows = df.select(once.alias("a"), catalog.declare(once, F.lit("NEW")).alias("b")).collect()
    assert [r.a for r in rows] == ["---\ncategory: NEW\n---\nbody", "---\ntitle: x\ncategory: NEW\n---\nbody\ncategory: no", "---\ncategory: NEW\ntitle: x\n---\nbody", None]
    assert [r.a for r in rows] == [r.b for r in rows]


def test_cells_keys_and_masks(spark):
    from quillmesh.functions import scalar

    r = spark.range(1).select(
        scalar.cell_format(F.lit(True), "boolean").alias("a"), scalar.cell_format(F.lit(3.0), "double").alias("b"), scalar.cell_format(F.lit(3.25), "double").alias("c"),
        scalar.cell_format(F.lit(None).cast("double"), "double").alias("d"), scalar.mask_words(F.lit("le été le les le"), "le").alias("e"),
        scalar.key_agrees(F.lit("A:B:7"), F.lit("A:B"), F.lit(7)).alias("f"), scalar.key_agrees(F.lit("C:7"), F.lit("A"), F.lit(7)).alias("g"), scalar.key_agrees(F.lit("7"), F.lit("A"), F.lit(7)).alias("h"),
    ).first()
    assert tuple(r) == ("TRUE", "3", "3.25", None, "••• été ••• les •••", True, False, True)


def test_nested_contacts_query_masks_every_line(spark, data):
    import hashlib

    import __spark_entry__ as entry
    from quillmesh.operators import guardrails

    got = {r.doc_id: (r.digest, r.lines) for r in entry.queries()["redact_nested_contacts"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        if r.text is not None:
            lines = r.text.split("\n")
            assert got[r.doc_id] == (hashlib.md5("\n".join(guardrails.redact_text(x) for x in lines).encode()).hexdigest(), len(lines))
