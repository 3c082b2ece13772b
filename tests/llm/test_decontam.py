from leadweave.llm.decontam import benchmark_matches

ITEM = "Tom has 12 apples and gives 5 apples to Mary, so how many apples does Tom keep after Mary eats 12 of the apples he gave her?"
OTHER = "the slow river bends twice before it meets the wide grey sea near our old stone bridge"


def matches(spark, texts, items):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, item int, w string")
    bench = spark.createDataFrame([(i, t, "y") for i, t in enumerate(items)], "item_id long, text string, lang string")
    return {(r["doc_id"], r["item_id"]) for r in benchmark_matches(docs, bench).collect()}


def test_exact_reparameterised_and_inconsistent(spark):
    filler = "words of another kind stand here and fill the page with nothing that is asked anywhere "
    texts = [
        filler * 3 + ITEM + " " + filler,
        filler + ITEM.replace("Tom", "Anna").replace("Mary", "Peter Paul").replace("12", "340").replace("5", "7.5"),
        filler + ITEM.replace("eats 12", "eats 13"),                       # one value of the item, two of the document
        filler + ITEM.replace("Mary", "Tom"),                              # two values of the item, one of the document
        filler * 40, None, "", OTHER.upper(), " ".join(OTHER.split()[:12]), " ".join(OTHER.split()[:11]),
        "once more: " + OTHER + ". " + OTHER, "1 2 3 4 5 6 7 8 9 " * 5000,
    ]
    assert matches(spark, texts, [ITEM, OTHER, None, "", "too short", ITEM.replace("5", "8")]) == {(0, 0), (1, 0), (7, 1), (8, 1), (10, 1)}


def test_units_repeats_and_empty_tables(spark):
    item = "a train leaves the first station and rides 30 km before the next one comes at full speed"
    assert matches(spark, [item.replace("30 km", "77 miles")] * 2, [item]) == {(0, 0), (1, 0)}
    assert matches(spark, [item], []) == set()
    assert matches(spark, [], [item]) == set()


def test_short_items_and_items_of_slots_are_found_as_a_whole(spark):
    prose = "some plain words go before and after it in the text "
    items = ["What is 17 * 23 + 4?", "How many legs do 3 cats have?", "Tom: 5, Anna: 6, Mary: 7, Peter: 8, John: 9, Paul: 10, Jane: 11", "Photosynthesis?",
             "red 1 blue 2 green 3 white 4 black 5 brown 6", "..."]
    texts = [prose + "What is 17 * 23 + 4? " + prose, prose + "what is 17 * 23 + 5 " + prose, prose + "How many legs do 12 dogs have? How many legs do 12 cats have?",
             prose + items[2] + ". " + prose, prose + "PHOTOSYNTHESIS, " * 3, prose + items[4].replace("5", "70"), prose + items[4].replace("white", "pink"), prose, items[0]]
    assert matches(spark, texts, items) == {(0, 0), (2, 1), (3, 2), (4, 3), (5, 4), (8, 0)}


def test_windows_without_slots_equal_values_and_slots_that_run_on(spark):
    long = "Tom has 12 apples and " + OTHER + " where he eats 12 of them"
    sums = "a worker digs 3 holes in the dry field on one day and then 5 holes more on the next day so how many are there"
    hours = "it takes 1 hour to walk there and it takes 2 hours to come back again on foot in the rain"
    edge = "write 40 as the sum of two other numbers that are both even and then also give the half of 40"
    texts = ["so " + long.replace("eats 12", "eats 13"), sums.replace("3", "4").replace("5", "4"), hours.replace("hours", "hour").replace("hour", "hours"),
             "now " + edge.replace("40", "60") + " 17 is the next one"]
    assert matches(spark, texts, [long, sums, hours, edge]) == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_names_at_the_start_of_sentences_and_copies_in_another_case(spark):
    item = "Tom has 5 red pens. Mary has 3 blue pens. Peter has 7 green pens. Anna has 4 old pens. How many pens do they have?"
    named = "On Monday Tom Smith met Mary Jones in Paris and gave Peter Paul his London ticket while Anna Lee and Bob Ray left Rome by train"
    other = item.replace("Tom", "Lisa").replace("Mary", "Max Paul").replace("Peter", "Rosa").replace("Anna", "Carl").replace("5", "50")
    filler = "and then some other words stand here "
    texts = [filler + other + " " + filler, filler + named.lower() + " " + filler, filler + named.upper(), named.replace(" ", "\n"),
             " ".join(named.lower().split()[:16]) + " " + filler, filler * 5]
    assert matches(spark, texts, [item, named]) == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 1)}


def test_query_finds_what_holds_an_item_and_nothing_that_shares_no_words(spark, sf):
    import re

    from leadweave.llm.queries import QUERIES

    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"] for r in QUERIES["op10_decontamination"](spark, sf).collect()}
    whole = {d for d, w in docs.items() if any(f" {' '.join(i)} " in f" {' '.join(w)} " for i in items.values())}
    parts = {tuple(i[k:k + 5]) for i in items.values() for k in range(len(i) - 4)}
    none = {d for d, w in docs.items() if not any(tuple(w[k:k + 5]) in parts for k in range(len(w) - 4))}
    assert len(whole) > 5 and whole <= found and not found & none and len(none) > 500
