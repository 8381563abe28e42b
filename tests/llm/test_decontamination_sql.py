"""The decontamination statement against the operator, on planted re-parameterised items."""

import duckdb
import pytest

from pricelens.llm import decontamination
from tests.llm.test_cases import prose

TRAIN = "the train leaves at 7 and the bus leaves at 7 and they meet at 7 near the bridge"
BOAT = "The boat leaves the harbour before noon. The captain counts all crates on the deck. The wind is calm today and the sea is flat."
SOLD = "Maria Lopez sold 12 boxes of red apples to Peter and then paid John Smith 5 dollars for a ride back to the market"
OTHER = "Anna sold 30 boxes of red apples to Mary Ann Jones and then paid Bob 7 dollars for a ride back to the market"
DROVE = "In 1995 Maria Lopez drove a car for 120 km from the old harbour to the small station and back again in 3 hours"
ROAD = ("we took the old road from the mill to the lake", "and saw a bird on each stone before the rain", "came down on us all at once")
FEW = ["What is 17 * 24 + 305?", "Solve 12 + 7 * 3 - 44 / 4 for X and Y", "THE BOAT LEAVES THE HARBOUR BEFORE NOON WITH ALL CRATES", "4 8 15 16 23 42"]
CASES = {
    "consistent": ([TRAIN], [TRAIN.replace("7", "9"), "the train leaves at 4 and the bus leaves at 5 and they meet at 6 near the bridge"], ["1", ""]),
    "edited": ([BOAT], [BOAT.replace("The captain", "A captain"), BOAT.replace("The", "A", 1), BOAT[BOAT.index("counts") :], prose(1, 200)], ["1", "1", "1", ""]),
    "few literals": (FEW, [*(prose(i, 30) + " " + t + " " + prose(i + 9, 30) for i, t in enumerate(FEW)), FEW[1].replace("44", "45"), "Solve 1 + 2 * 3 for X", "4 8 15 16 23 43", "THE CAR STOPS AT A STATION BEFORE NIGHT WITH NO CRATES"], ["1", "2", "3", "4", "2", "", "", ""]),
    "other lengths": ([SOLD, " ".join(ROAD)], [OTHER, prose(5, 30) + " " + OTHER + " " + prose(6, 30), " then ".join(ROAD), prose(7, 90)], ["1", "1", "2", ""]),
    "units and repeats": ([DROVE, None, "", "short one here", DROVE], [DROVE.replace("120 km", "75 mi").replace("Maria", "Eva"), "a short one here", None, "", prose(5, 40) + " " + DROVE, DROVE.replace("120 km", "120")], ["1", "4", "", "", "1", "1"]),
}


@pytest.mark.parametrize("name", CASES)
def test_statement_equals_operator(spark, name):
    items, texts, want = CASES[name]
    benchmark, docs = list(enumerate(items, 1)), list(enumerate(texts, 1))
    got = {r["doc_id"]: (r["n_items"], r["item_ids"], r["contaminated"]) for r in decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")).collect()}
    con = duckdb.connect()
    for table, key, rows in (("benchmark", "item_id", benchmark), ("documents", "doc_id", docs)):
        con.execute(f"CREATE TABLE {table} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {table} VALUES (?, ?)", rows)
    said = {i: (n, ids, leak) for i, n, ids, leak in con.execute(f"SELECT doc_id, n_items, item_ids, contaminated FROM ({decontamination.OP4_SQL})").fetchall()}
    assert said == got and [got[i][1] for i, _ in docs] == want
