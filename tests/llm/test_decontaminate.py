"""Leaks of benchmark items: whole, re-cased, re-parameterised and contradicting copies, and clean texts."""

import random

from pyspark.sql import functions as F

from ratewell.llm import decontaminate

rng = random.Random(3)
WORDS = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(4000)]


def prose(n):
    return " ".join(rng.choices(WORDS, k=n))


PLAIN = prose(30)
PUZZLE = ("yesterday in town Anna bought 12 apples and gave 5 kg of flour to Boris because Anna wanted to bake 12 small cakes "
          "for Boris and his 7 friends in Paris")
MOVED = PUZZLE.replace("Anna", "Clara").replace("Boris", "David").replace("12", "40").replace("5 kg", "9 pounds").replace("Paris", "Rome")
BROKEN = MOVED.replace("because Clara", "because Emil").replace("for David", "for Fritz").replace("bake 40", "bake 41")
ITEMS = [(1, PLAIN), (2, PUZZLE), (3, "too short"), (4, None), (5, ""), (1, PLAIN), (None, prose(20))]
DOCS = [(10, prose(400)), (11, prose(50) + " " + PLAIN + " " + prose(50)), (12, PLAIN.upper()), (13, prose(9) + ". " + PUZZLE),
        (14, prose(9) + " " + MOVED + " " + prose(30)), (15, BROKEN), (16, PUZZLE.lower()), (17, None), (18, ""), (19, "too short"),
        (20, prose(60_000) + "\n" + PLAIN), (21, " ".join(PLAIN.split()[:8])), (22, " ".join(PLAIN.split()[5:25])), (None, PLAIN), (11, PLAIN),
        (23, "1 2 3 4 5 6 7 8 9 10 " * 50), (24, PLAIN.replace(" ", " \n"))]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks(spark, frame):
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(DOCS), items(spark, ITEMS)).collect()}
    assert got == {(11, 1), (12, 1), (13, 2), (14, 2), (16, 2), (20, 1), (22, 1), (24, 1)}
    kept = decontaminate.without_leaks(frame(DOCS), items(spark, ITEMS))
    assert kept.dtypes == frame(DOCS).dtypes
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("10 15 17 18 19 21 23 None".split())
    assert decontaminate.leaks(frame(DOCS), items(spark, ITEMS).limit(0)).count() == 0
    assert decontaminate.leaks(frame(DOCS).limit(0), items(spark, ITEMS)).count() == 0


def test_every_offset_and_values_of_any_length(spark, frame):
    """Values that turn decimal, signed or get thousands, and longer names, at all places; a slot stays one value."""
    short = "my friend Anna keeps 2 dollars for 5 pens and the shop sells 35 pens to us"
    other = "my friend Clara Maria Jones keeps 1.50 dollars for -7 pens and the shop sells 1,250.75 pens to us"
    chain = "take 4 boxes from room 12 and put 30 boxes into room 9 then carry 4 boxes back"
    changed = chain.replace("4 boxes", "2,400 boxes").replace("12", "0.5").replace("30", "1,000,000")
    twisted = "take 3 boxes from room 12.5 and put 7 boxes into room 12.5 then carry 8,000 boxes back"
    docs = [(10 * k + offset, prose(20 + offset) + " " + text + " " + prose(11)) for k, text in enumerate([other, changed, twisted, short]) for offset in range(3)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(docs), items(spark, [(1, short), (2, chain)])).collect()}
    assert got == {(0 + k, 1) for k in range(3)} | {(10 + k, 2) for k in range(3)} | {(30 + k, 1) for k in range(3)}


def test_a_number_is_one_word(spark):
    text = "Pay 62.5 or 1,200 of -3 (+4) at .5 and 7-4, 3x − 2.5kg by 1.250,50 in 2019. Then ask Mary Ann Smith-Jones now"
    row = spark.createDataFrame([(text,)], "text string").select(decontaminate.raw_words(F.col("text")).alias("w")).first()
    assert row.w == ["pay", "62.5", "or", "1,200", "of", "-3", "+4", "at", ".5", "and", "7", "4", "3x", "2.5kg", "by", "1.250,50", "in", "2019",
                     "then", "ask", "\x01mary \x01ann \x01smith-jones", "now"]


def test_dense_items(spark, frame):
    """Arithmetic and lists of names are found as verbatim copies; other numbers in the same places are none."""
    dense = ["Compute 12 + 7 * 3 - 4 and 15 * 6 - 8 / 2, then add 31 + 18 * 5 to 44 / 11 - 2.",
             "Solve for x: 3x + 12 = 48, 5x - 7 = 33, 2x + 9 = 41.",
             "we know that Anna, Boris, Clara, David, Emil, Fritz, Greta and Hans met at 3, 4, 5, 6 and 7 in 2019"]
    mixed = "how much is 3 plus 4 minus 5 times 6 over 7 of 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27"
    wanted = [(k, text) for k, text in enumerate(dense)] + [(3, mixed)]
    docs = [(10 * k + offset, prose(20 + offset) + ". " + text + " " + prose(11)) for k, text in wanted for offset in range(3)]
    docs += [(90, prose(9) + ". Solve the rest: 4x + 11 = 49, 6x - 8 = 34, 3x + 7 = 51. " + prose(9)), (91, "1 2 3 4 5 6 7 8 9 10 11 12 " * 20),
             (92, "how much is 30 plus 40 minus 50 times 60 over 70 of " + " ".join(str(k) for k in range(80, 280, 10)))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(docs), items(spark, wanted)).collect()}
    assert got == {(10 * k + offset, k) for k in range(4) for offset in range(3)} | {(92, 3)}


def test_rows_of_one_document_and_words_as_values(spark, frame):
    """Another copy under the same doc_id takes nothing away; units, times and numbers in words are values too."""
    again = MOVED.replace("40", "77").replace("David", "Xaver")
    tank = "The tank by the barn loses 40 litres of clean water per day while rain brings 12 litres back to it"
    tank_other = tank.replace("40 litres", "900 gallons").replace("12 litres", "3.5 gallons").replace("per day", "per week")
    fruit = "Carry three baskets with twelve apples to the old mill and come home with seven baskets of bread"
    fruit_other = fruit.replace("three", "five").replace("twelve", "twenty").replace("seven", "40")
    docs = [(10, MOVED), (11, MOVED), (11, again), (12, prose(5) + " " + tank_other), (13, fruit_other + " " + prose(9)), (14, prose(3) + " 0n 0p 0u " + prose(30))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(docs), items(spark, [(2, PUZZLE), (5, tank), (6, fruit)])).collect()}
    assert got == {(10, 2), (11, 2), (12, 5), (13, 6)}
