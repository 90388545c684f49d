"""Text readers on small files, several per folder and split into small blocks."""

import random

import pytest

from restock.sources import text_instances as ti


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbered_lines_over_many_blocks(spark, tmp_path, small_blocks):
    for name, n in (("a", 300), ("b", 7)):
        text = "# comment\n\n" + "".join(f"  {i}   x{i}\n" + ("\n" if i % 5 == 0 else "") for i in range(n))
        (tmp_path / f"{name}.txt").write_text(text)
    lines = ti.numbered_lines(spark, str(tmp_path)).collect()
    assert len(lines) == 307
    assert all(r.text == f"{r.line_no} x{r.line_no}" for r in lines)


def test_wrapped_matrix(spark, tmp_path, small_blocks):
    rng = random.Random(0)
    n = 23
    values = [[rng.randrange(100) for _ in range(n)] for _ in range(n)]
    lines = [f"# costs\n{n}"]
    for row in values:
        cut = rng.randrange(1, n)
        lines += [" ".join(map(str, row[:cut])), " ".join(map(str, row[cut:]))]
    (tmp_path / "m.txt").write_text("\n".join(lines))
    got = ti.read_wrapped_matrix(spark, str(tmp_path)).collect()
    assert len(got) == n * n
    assert all(r.cost == values[r.row][r.col] for r in got)


def test_instance_with_header(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# edges\n3 2 9\n1 2 5 1\n2 3 6 1\n")
    meta, rows = ti.read_instance(spark, str(tmp_path), ["n", "m", "budget"], ["u", "v", "d", "c"])
    assert meta.first().budget == 9
    shifted = ti.shift_to_zero_based(rows, ["u", "v"])
    assert sorted((r.u, r.v, r.d) for r in shifted.collect()) == [(0, 1, 5), (1, 2, 6)]


def test_warehouse_lines(spark, tmp_path):
    (tmp_path / "w.txt").write_text("2 2\n50 7.5\n60 0.\n10\n5. 20.\n4\n8 2\n")
    depots, demands, costs = ti.read_warehouse_instance(spark, str(tmp_path))
    assert sorted((r.warehouse_id, r.capacity, r.opening_cost) for r in depots.collect()) == [(0, 50, 7.5), (1, 60, 0.0)]
    assert sorted((r.customer_id, r.demand) for r in demands.collect()) == [(0, 10), (1, 4)]
    assert sorted((r.customer_id, r.warehouse_id, r.unit_cost) for r in costs.collect()) == [
        (0, 0, 0.5), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 0.5),
    ]


def test_blocks(spark, tmp_path):
    (tmp_path / "p.dat").write_text(
        "set PRODUCTS :=\n'Brown bread'\n'Eggs'\n;\n\nparam Demand :=\n['Eggs','North','2024-15-08'] 12\n;\nparam Unmet := 100;\n"
    )
    rows = {(r.block, tuple(r["items"]), r.value) for r in ti.read_blocks(spark, str(tmp_path)).collect()}
    assert rows == {
        ("PRODUCTS", ("Brown bread",), None),
        ("PRODUCTS", ("Eggs",), None),
        ("Demand", ("Eggs", "North", "2024-15-08"), 12),
        ("Unmet", (), 100),
    }
