import duckdb
import pytest

from curatrix.llm import decontaminate
from tests.llm import cases

ITEM = "a farmer named Alice has 12 red apples and 7 green pears in her basket so Alice gives 12 of them to Robert at noon today"


def leaking(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    return set(range(len(texts))) - kept


def test_parameters_may_change_but_consistently(spark):
    other = ITEM.replace("12", "41").replace("7 ", "9 ").replace("Alice", "Maria").replace("Robert", "Pedro")
    lines = "prefix words before it. " + other.upper().lower() + " and words after."
    cups = "put 4 red cups and 4 blue cups and 4 green cups and 4 old cups on the table"
    torn = "put 5 red cups and 6 blue cups and 7 green cups and 8 old cups on the table"  # one value of the item stands for four
    texts = [
        ITEM,
        "Some text first, then: " + ITEM.replace(" ", "\n  ") + " and more.",
        other,
        torn,
        "a farmer has many apples and some pears in a basket and gives them to nobody at all today",
        " ".join(ITEM.split()[6:19]),  # thirteen words
        " ".join(ITEM.split()[7:19]),  # twelve
        lines,
    ]
    # the last one has other names in small letters: its longest stretch without one is twelve words
    assert leaking(spark, texts, [ITEM, cups, "only four words here", "", None]) == {0, 1, 2, 5}


def test_a_run_is_cut_at_the_torn_slot(spark):
    head = "each of the 24 boxes on the long shelf by the door holds 6 blue cups and two old plates so that"
    item = head + " all the boxes on it would take 24 hours to count for one man alone"
    texts = [item.replace("take 24", "take 31"), item.replace("the 24 boxes", "the 31 boxes"), item.replace("24", "31")]
    assert leaking(spark, texts, [item]) == {0, 1, 2}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    runs = sorted(r.run for r in decontaminate.leaks(docs, bench).collect())
    n, at = len(item.split()), item.split().index("24", 5)
    assert runs == [at - 7, at - 7, n - 7]


def test_units_are_typed(spark):
    a = "the long road between both towns is 40 km of old stone and takes 3 hours by cart every single day"
    b = a.replace("40 km", "25 miles").replace("3 hours", "90 minutes")
    assert leaking(spark, [b], [a]) == {0}


def test_edge_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, cases.LONG[:400]), (3, ITEM), (3, ITEM), (None, ITEM)], "item_id long, text string")
    docs = cases.docs(spark, [*cases.ROWS, (8, cases.LONG + " " + ITEM, "en", "src1")])
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    held = {4, 8}  # both hold the beginning of the long text
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in cases.ROWS if r[0] not in held)
    assert decontaminate.clean(cases.docs(spark, []), bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(cases.ROWS) + 1
    assert {(r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {3, None}


def test_dense_items(spark):
    ran = "On Monday Ann ran 5 km in 30 minutes, on Tuesday Bob ran 8 km in 45 minutes, and on Friday Tom ran 12 km in 70 minutes. Who was fastest?"
    sums = "Compute 12 + 7 * 3 - 4 where x = 5 and y = 6 and z = 9 then add 8 and 2 to it"
    table = " ".join(str(n * n) for n in range(3, 23))
    other = ran.replace("Ann", "Eve").replace("Bob", "Max").replace(" 5 ", " 6 ").replace("45", "50").replace("70", "81")
    numbers = " ".join(str(n * n + 1) for n in range(3, 23))
    asked = "What is 3 + 4 * 5 - 6 if x = 7 and y = 8 and the result is divided by 2"
    texts = [ran, sums, table, other, numbers, "Before it: " + sums + " and after", asked, asked.replace("7", "9").replace("3 +", "11 +")]
    assert leaking(spark, texts, [ran, sums, table, asked]) == {0, 1, 2, 3, 5, 6, 7}


def test_copies_without_capitals_or_in_capitals(spark):
    other = ITEM.replace("12", "41").replace("7 ", "9 ")
    texts = [ITEM.lower(), ITEM.upper(), "words before it " + other.lower() + " and words after"]
    assert leaking(spark, texts, [ITEM]) == {0, 1, 2}


def test_short_items_match_whole(spark):
    item = "Mary bought 14 pens for her two sisters at school"
    texts = [
        item,
        "He said: mary bought 14 pens for her two sisters at school, yes",
        "John bought 3 pens for her two sisters at school.",
        " ".join(item.split()[:-1]),
        "Mary bought 14 pens for her three sisters at school",
        "who ran the first and the second of these races",
        "7 and 9 and 7 make a nice number here",
        "7 and 9 and 8 make a nice number here",
    ]
    assert leaking(spark, texts, [item, "who ran the first", "5 and 6 and 5 make a nice number here"]) == {0, 1, 2, 6}


def test_a_name_may_open_a_sentence(spark):
    a = "John has 5 apples in one small bag and two more in another one"
    docs = spark.createDataFrame([(1, a.replace("John", "Mary").replace("5", "8"))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert [r.run for r in decontaminate.leaks(docs, bench).collect()] == [len(a.split()) - 7]


FRAMES = (
    "{a} left home at {n} and walked {m} km to the house of {b}, who gave {a} back {n} coins before dinner.",
    "If {n} machines make {m} parts in {n} minutes, how long do {m} machines need for all of these parts in the end?",
    "Compute {n} + {m} * {n} - {m} where x = {n} and y = {m}.",
    "A train of {n} m passes a bridge of {m} m while {a} counts the {n} wagons and {b} the {m} pillars below.",
    "{a} and {b} share {n} apples and {m} pears.",
)


@pytest.fixture(scope="module")
def planted():
    """Items in five frames, documents with each of them under other numbers and names, and clean ones of their words."""
    names = ("Anna", "Boris", "Clara", "Dmitri", "Elena", "Farid")
    items, docs = [], []
    for i in range(40):
        frame = FRAMES[i % len(FRAMES)]
        items.append((i, frame.format(a=names[i % 6], b=names[(i + 1) % 6], n=10 + i, m=200 + i)))
        docs.append((i, "Words that come first. " + frame.format(a=names[(i + 2) % 6], b=names[(i + 5) % 6], n=500 + 3 * i, m=7000 + i) + " Words that follow it here."))
        words = items[-1][1].split()
        docs.append((1000 + i, "Of all these things " + " and then ".join(words[k] for k in range(0, len(words), 3)) + " remain."))
    return items, docs


def test_planted_questions(spark, planted):
    items, docs = planted
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in decontaminate.clean(texts, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {d for d, _ in docs if d >= 1000}  # recall 1, no clean document lost
    assert got.count() >= 40


def test_sql_has_the_same_rule(spark, planted, tmp_path):
    items, docs = planted
    docs = docs + [(2000, ITEM), (2001, None), (2002, ""), (2003, ITEM.replace("gives 12", "gives 99")), (2003, ITEM.lower())]
    items = items + [(90, ITEM), (90, ITEM), (91, None), (92, "Mary bought 14 pens for her two sisters"), (None, ITEM.upper())]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(map(str, con.execute(decontaminate.OP2_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in decontaminate.op2_template_decontamination(spark, str(tmp_path)).collect()) == want
    assert len(want) > 40
