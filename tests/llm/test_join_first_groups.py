"""A pair of classes leaves one of the groups that it has in common, however many these are."""

import random

import pytest
from test_join_candidates import near_copies, shared_passage
from test_llm import brute_classes, make

from tilespark.llm import simjoin

T = simjoin.Threshold(3, 70, 100)


def test_a_pair_is_made_in_one_of_its_groups(spark, monkeypatch):
    """Near copies share dozens of signatures in groups of more than nine."""
    made, plain = [], type(spark.range(1)).mapInArrow

    def counted(self, work, schema, *more, **named):
        out = plain(self, work, schema, *more, **named)
        if schema == "a long, b long" and "sketch" in self.columns:
            made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", counted)
    rows = list(enumerate(near_copies(30, 1) + near_copies(14, 2)))
    assert {tuple(r) for r in simjoin.classes(make(spark, rows), T).collect()} == brute_classes(rows, T)
    assert made and made[0][0] <= 1.5 * made[0][1]  # many times the pairs before


@pytest.mark.parametrize("most", [1, 2, 32])
def test_lists_of_any_length_lose_no_link(spark, monkeypatch, most):
    """Also where lists have no group in common, and in runs and blocks of all sizes."""
    for name, value in (("FIRST_GROUPS", most), ("NEAR", 1), ("REACH", (2,)), ("RUN", 8), ("PAIR_BLOCK", 5)):
        monkeypatch.setattr(simjoin, name, value)
    rows = list(enumerate(near_copies(30, 3) + shared_passage(30, 4) + near_copies(5, 5)))
    random.Random(6).shuffle(rows)
    assert {tuple(r) for r in simjoin.classes(make(spark, rows), T).collect()} == brute_classes(rows, T)
