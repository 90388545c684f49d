"""The registered queries: rows equal to the check SQL where there is one, columns and types as agreed."""

import pytest

import __spark_entry__ as entry
from restock.llm.queries import ORACLES, QUERIES
from tools.check import compare, duck

FOLDER = "/root/testdata/sf0.001"

COLUMNS = {
    "op2": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op4": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8": "page_id bigint, url string, text string, n_chars bigint",
    "op9": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op11": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string",
    "op12": "lang string, source string, part string, item string, value bigint, rank int",
    "op13": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_check_sql(spark, name):
    status, _ = compare(spark, duck(FOLDER), name, FOLDER)
    assert status.startswith("ok"), status


@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_columns(spark, number):
    name = next(n for n in QUERIES if n.startswith(f"{number}_"))
    have = dict(QUERIES[name](spark, FOLDER).dtypes)
    for column in COLUMNS[number].split(", "):
        title, kind = column.split(" ")
        assert have[title] == kind
