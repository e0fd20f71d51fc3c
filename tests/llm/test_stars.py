"""Stars: rounds of a group that has few members."""

from itertools import combinations

from pyspark.sql import functions as F

from cargoloom.llm.stars import star_components


def test_small_groups_meet_whole_in_one_round(spark):
    members, linked, rounds = 40, {(7, 9), (9, 30)}, []
    entries = spark.createDataFrame([(1, n) for n in range(members)] + [(2, 38), (2, 39), (3, 50)], "key long, node long")
    facts = entries.select("node", F.col("node").alias("fact")).distinct()

    def confirm(pairs):
        rounds.append({tuple(r) for r in pairs.select("c", "v").collect()})
        return pairs.where(" OR ".join(f"(c = {c} AND v = {v})" for c, v in sorted(linked)))

    found = star_components(entries, facts, lambda one, other: F.lit(True), lambda nodes: confirm)
    assert {tuple(r) for r in found.collect()} == {(7, 7), (9, 7), (30, 7)}
    assert set().union(*rounds) == set(combinations(range(members), 2)) and sum(map(len, rounds)) == members * (members - 1) // 2
    assert len(rounds) == 2
