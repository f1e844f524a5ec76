"""Edge cases of the proofs: shared ids, names with several archives, units that chains link, files that were cut before."""

import random

from reminisce.operators import evidence


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_foreign_ids(spark):
    c = spark.createDataFrame([(1, "a:channel:x", True), (2, "a:channel:x:thread:1", True), (3, "a:channel:x:active-memory:1", True), (4, None, True), (5, "a:channel:xy", False)], "conversation_id long, session_key string, active boolean")
    ids = lambda *r: spark.createDataFrame(list(r), "conversation_id long, raw_id string")
    stored = ids((1, "own"), (2, "kin"), (3, "kin"), (4, "far"), (5, "gone"), (4, "far"), (4, None))
    batch = ids(*((i, x) for i in (1, 2, 4) for x in ("own", "kin", "far", "gone", "new", None, "new")))
    # the channel's base session spares its threads and memory; a thread spares itself alone; inactive holders never count
    assert rows(evidence.foreign_ids(batch, stored, c)) == [(1, 5, 1), (2, 5, 3), (4, 5, 2)]


def test_reset_evidence(spark):
    tracked = spark.sql("""select * from values
        (1L, 'f', timestamp'2024-01-02 00:00:00', 's', 's', timestamp'2024-01-01 10:00:30'), (2L, 'f.reset.x', timestamp'2024-01-02 00:00:00', 's', 's', timestamp'2024-01-01 09:59:59'),
        (3L, 'g', timestamp'2024-01-02 00:00:00', ' ', ' ', timestamp'2024-01-01 10:00:00'), (4L, cast(null as string), null, null, null, null), (5L, 'h', null, 's', 's', timestamp'2024-01-01 10:00:00')
        as t(conversation_id, path, pruned_at, session_id, header_id, header_at)""")
    stamp = "2024-01-01T10-00-00Z"
    files = spark.createDataFrame([("f.reset.x",), (f"f.reset.x.reset.{stamp}",), (f"f.reset.{stamp}",), ("g.reset.",), (f"h.reset.{stamp}",), ("fa",)], "path string")
    got = [(r[0], r[1], r[2] is not None, r[3], r[4]) for r in rows(evidence.reset_evidence(tracked, files))]
    assert got == [(1, True, True, True, True), (2, True, True, True, False), (3, True, False, True, False), (4, False, False, False, False), (5, True, True, False, False)]


def test_pair_units(spark):
    """Random pairs and one long chain against a closure; ids on one side alone link nothing."""
    rng = random.Random(3)
    calls = {(1, rng.randrange(40), f"c{rng.randrange(60)}") for _ in range(50)} | {(2, 2 * i, f"k{i}") for i in range(40)} | {(1, 90, "lone"), (1, 91, "lone")}
    results = {(1, rng.randrange(40, 80), f"c{rng.randrange(60)}") for _ in range(50)} | {(2, 2 * i + 1, f"k{j}") for i in range(39) for j in (i, i + 1)}
    unit = {(c, p): p for c, p, _ in calls | results}
    changed = True
    while changed:
        changed = False
        for c, p, x in calls:
            for d, q, y in results:
                if (c, x) == (d, y) and unit[c, p] != unit[c, q]:
                    unit[c, p] = unit[c, q] = min(unit[c, p], unit[c, q])
                    changed = True
    frame = lambda r: spark.createDataFrame(sorted(r) + [(1, 95, None)], "conversation_id long, place long, call_id string")
    assert rows(evidence.pair_units(frame(calls), frame(results))) == sorted((c, p, u) for (c, p), u in unit.items())


def test_nothing(spark):
    none = spark.createDataFrame([], "conversation_id long, place long, seq long, call_id string, entry_id string, parent_id string, identity_hash string, content string")
    assert not rows(evidence.pair_units(none, none)) and not rows(evidence.append_evidence(none, none)) and not rows(evidence.fully_stored(none, none))


def test_thresholds_without_rules(spark):
    d = spark.sql("select 0.5d as threshold, 'override' as source, 0 as fresh_tail, cast(null as int) as chunk, 0.7d as live_threshold, 'global' as live_source, 4 as live_fresh_tail, 5 as live_chunk, 'm' as model, '' as session_key, 9 as context_window union all select double('nan'), 'global', 1, 2, 0.7d, 'global', 4, 5, null, null, null")
    got = evidence.debt_thresholds(d, []).select("threshold", "source", "fresh_tail", "chunk", "superseded")
    assert rows(got) == [(0.7, "global", 4, 5, False), (0.7, "global", 4, 5, True)]
    got = evidence.debt_thresholds(d.filter("source = 'override'"), [{"threshold": 0.5, "model": "m", "fresh_tail": 3}]).select("threshold", "source", "fresh_tail", "chunk", "superseded")
    assert rows(got) == [(0.5, "override", None, None, False)]
