from dataclasses import replace
from pathlib import Path

import pytest

from basewright.plans.build import enriched_base
from basewright.plans.save import save_base
from basewright.plans.templates import ELIGIBILITY_EXACT
from basewright.sinks import shared
from basewright.sinks.tables import export_csv, preview, save_split, save_table, split_values
from basewright.sources.fixtures import fixture_tables

COLUMNS = ELIGIBILITY_EXACT.columns


@pytest.fixture(scope="module")
def base(spark):
    return enriched_base(fixture_tables(spark, "/root/testdata/sf0.01"), ELIGIBILITY_EXACT)


def test_split_tables_are_disjoint_and_complete(base, rows, tmp_path):
    saved = save_split(base, "whole", "segment_lateness", COLUMNS, folder=str(tmp_path))
    assert sorted(saved) == sorted(
        f"whole_{s}_{l}" for s in ("cc_only", "ll_only", "multi_debt") for l in ("short", "long")
    )
    together = [row for table in saved.values() for row in rows(table)]
    assert len(together) == len(set(together))
    assert sorted(together) == sorted(rows(base.select(*COLUMNS)))
    for name, table in saved.items():
        assert {f"whole_{s}_{l}" for _, l, s, _ in rows(table)} <= {name}


def test_a_split_is_written_once_and_leaves_nothing_in_the_shared_folder(spark, base, tmp_path):
    before = set(Path(shared.shared_folder(spark)).rglob("*.parquet"))
    for _ in range(2):
        saved = save_split(base, "once", "segment", COLUMNS, folder=str(tmp_path))
    assert set(Path(shared.shared_folder(spark)).rglob("*.parquet")) == before
    newest = {f.rsplit("/split_segment", 1)[0] for t in saved.values() for f in t.inputFiles()}
    assert len(newest) == 1 and len(list(tmp_path.iterdir())) == 2
    assert spark.read.parquet(*newest).count() == sum(t.count() for t in saved.values())
    assert spark.table("once_multi_debt").count() == saved["once_multi_debt"].count() > 0


def test_split_columns_need_not_be_kept(base, tmp_path):
    saved = save_split(
        base, "slim", "lateness", ["customer__id"], lateness=["long"], folder=str(tmp_path)
    )
    assert list(saved) == ["slim_long"]
    assert saved["slim_long"].columns == ["customer__id"]
    assert saved["slim_long"].count() == base.where("lateness = 'long'").count()


def test_split_caps(base, tmp_path):
    saved = save_split(
        base,
        "capped",
        "segment",
        COLUMNS,
        row_cap=4,
        caps={"multi_debt": 2},
        folder=str(tmp_path),
    )
    counts = {name: table.count() for name, table in saved.items()}
    assert counts == {"capped_cc_only": 4, "capped_ll_only": 4, "capped_multi_debt": 2}


def test_a_combination_without_rows_is_an_empty_table(base, tmp_path):
    none = base.where("segment = 'cc_only'")
    saved = save_split(none, "empty", "segment", COLUMNS, folder=str(tmp_path))
    assert saved["empty_ll_only"].count() == 0
    assert saved["empty_ll_only"].columns == list(COLUMNS)
    nothing = save_split(base.where("1 = 0"), "none", "lateness", COLUMNS, folder=str(tmp_path))
    assert [t.count() for t in nothing.values()] == [0, 0]


def test_senseless_splits_are_refused(base):
    for options in ({"segments": []}, {"segments": ["rich"]}, {"lateness": []}):
        with pytest.raises(ValueError):
            split_values("segment_lateness", **options)
    with pytest.raises(ValueError):
        split_values("country")
    with pytest.raises(ValueError):
        save_split(base.drop("segment"), "x", "segment", ["customer__id"])
    with pytest.raises(ValueError):
        save_split(base, "x", "segment", COLUMNS, row_cap=5, caps={"cc_only": 0})


def test_saving_a_spec(spark, base, rows, tmp_path):
    tables = fixture_tables(spark, "/root/testdata/sf0.01")
    spec = replace(ELIGIBILITY_EXACT, row_cap=20)
    [single] = save_base(tables, spec, "single", folder=str(tmp_path)).values()
    assert single.count() == 20
    split = save_base(
        tables, spec, "many", "lateness", caps={"long": 3}, folder=str(tmp_path), staged=True
    )
    short = base.where("lateness = 'short'").count()
    counts = {name: t.count() for name, t in split.items()}
    assert counts == {"many_long": 3, "many_short": min(20, short)}
    assert set(rows(split["many_long"])) <= set(rows(base.select(*COLUMNS)))


@pytest.mark.parametrize(
    "changes,options",
    [
        ({}, {"caps": {"long": 3}}),
        ({"segment": "cc_only"}, {"split": "segment"}),
        ({"product_segment": False}, {"split": "segment"}),
        ({"product_segment": False}, {"split": "segment_lateness"}),
        ({"lateness_cutoff": None}, {"split": "lateness"}),
        ({}, {"split": "segment", "segments": ()}),
        ({}, {"split": "segment", "segments": ("cc_only", "multidebt")}),
        ({}, {"split": "segment", "caps": {"cc_onli": 9}}),
    ],
)
def test_wishes_that_cannot_be_saved(spark, changes, options):
    tables = fixture_tables(spark, "/root/testdata/sf0.01")
    with pytest.raises(ValueError):
        save_base(tables, replace(ELIGIBILITY_EXACT, **changes), "never", **options)


def test_saving_replaces(spark, tmp_path, capsys):
    save_table(spark.range(5), "again", str(tmp_path))
    assert save_table(spark.range(3), "again", str(tmp_path)).count() == 3
    preview(spark, "again", 2)
    assert "only showing top 2 rows" in capsys.readouterr().out
    assert save_table(spark.range(2), "in_the_warehouse").count() == 2


def test_csv_has_a_header_and_one_file_when_asked(spark, tmp_path):
    save_table(spark.range(100).repartition(4), "numbers", str(tmp_path))
    [path] = export_csv(spark, ["numbers"], f"{tmp_path}/csv", single_file=True)
    [part] = list((tmp_path / "csv" / "numbers").glob("*.csv"))
    lines = part.read_text().splitlines()
    assert lines[0] == "id" and len(lines) == 101
    export_csv(spark, ["numbers"], f"{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(path).count() == 100


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared.new_path(spark, "x").startswith(f"{named}/basewright/x-")


class Session:
    """Just the options of a session."""

    def __init__(self, **options):
        self.options = {k.replace("_", "."): v for k, v in options.items()}
        self.conf = self

    def get(self, name, default=None):
        return self.options.get(name, default)


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session(spark_master="yarn"))
    local = Session(spark_master="local[2]", spark_sql_warehouse_dir="/w/")
    assert shared.shared_folder(local) == "/w/_steps"
    assert shared.shared_folder(Session(spark_checkpoint_dir="s3://b/x/")) == "s3://b/x"
