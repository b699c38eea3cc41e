"""The planner over small relations: scope, choice, missing, duplicates, layouts, strictness, order independence."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from setforge.plans import planner

ENTRY = "dat_name string, game_name string, parent_name string, rom_name string, sha1 string"
SOURCE = "source_root string, canonical_path string, entry_name string, kind string, sha1 string, seq long"


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def sources(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SOURCE)


E = [("d", "parent", None, "p.rom", "a"), ("d", "clone", "parent", "c.rom", "b"), ("d", "other", "gone", "o.rom", "x"), ("e", "parent", None, "p.rom", "a")]
S = [("/s", "/s/z", None, "bare", "a"), ("/s", "/s/a", None, "bare", "a"), ("/s", "/s/a.zip", "z.rom", "zip", "a"), ("/s", "/s/c.7z", "q", "archive", "a"), ("/s/sub", "/s/sub/b.zip", "b", "zip", "b"), ("/s-other", "/s-other/x", None, "bare", "x")]


def test_missing_matched_and_summary(spark):
    e, s = planner.scope_entries(entries(spark, E), "d"), planner.scope_sources(sources(spark, S), "/s")
    assert [tuple(r) for r in planner.missing(e, s).collect()] == [("other", "o.rom", "x")]
    assert planner.matched(e, s).count() == 2
    assert tuple(planner.summary(e, s).first()) == (2, 1, 1, 0, True)
    assert tuple(planner.summary(e, s, strict=True).first()) == (2, 1, 1, 2, False)
    assert not planner.summary(e, s, dry_run=True).first().writes_files
    assert tuple(planner.summary(e.limit(0), s, strict=True).first()) == (0, 0, 0, 0, False)


def test_choice_among_candidates(spark):
    rows = [("/s", "/s/b.zip", "dup.rom", "zip", "h"), ("/s", "/s/c.7z", "dup.rom", "archive", "h"), ("/s", "/s/a.zip", "z.rom", "zip", "h"), ("/s", "/s/z", None, "bare", "h"), ("/s", "/s/a.zip", "a.rom", "zip", "h"), ("/s", "/s/a", None, "bare", "h")]
    s = sources(spark, rows)
    order = [planner_name(c) for c in planner.candidate_lists(s).first().candidates]
    assert order == ["/s/a", "/s/z", "/s/a.zip:a.rom", "/s/a.zip:z.rom", "/s/b.zip:dup.rom", "/s/c.7z:dup.rom"]
    d = planner.duplicate_matches(entries(spark, [("d", "g", None, "r", "h")]), s).first()
    assert (d.selected, d.n_candidates) == ("/s/a", 6)


def planner_name(c):
    return c.canonical_path + (f":{c.entry_name}" if c.entry_name else "")


@pytest.mark.parametrize("mode, names", [(planner.PARENT_BUNDLES, {"parent.zip": 2}), (planner.PER_GAME, {"parent.zip": 1, "clone.zip": 1})])
def test_layouts(spark, mode, names):
    e, s = planner.scope_entries(entries(spark, E), "d"), planner.scope_sources(sources(spark, S), "/s")
    assert {r.zip: len(r.entries) for r in planner.bundles(e, s, mode).collect()} == names


def test_parent_text_is_taken_as_it_is(spark):
    e = entries(spark, [("d", "g", "", "r", "a"), ("d", "g2", "not-in-catalogue", "r2", "a")])
    assert {r.zip for r in planner.bundles(e, sources(spark, S)).collect()} == {".zip", "not-in-catalogue.zip"}


def test_hot_digest_is_summed_up_before_the_shuffle(spark):
    plan = planner.best_sources(sources(spark, S))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(range(len(S))))
def test_order_of_input_does_not_matter(spark, order):
    e = entries(spark, E[::-1])
    s = spark.createDataFrame([(*S[k], k) for k in order], SOURCE)
    got = sorted((r.zip, r.rom_name, r.canonical_path) for r in planner.bundle_entries(e, s).collect())
    assert got == [("gone.zip", "o.rom", "/s-other/x"), ("parent.zip", "c.rom", "/s/sub/b.zip"), ("parent.zip", "p.rom", "/s/a"), ("parent.zip", "p.rom", "/s/a")]
