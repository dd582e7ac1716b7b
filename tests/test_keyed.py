"""The memory as keyed state: many batches, restarts, counts, hot blocks."""

import datetime as dt
import hashlib
from collections import defaultdict

import pytest

from tamarisk.operators import memory
from tamarisk.sources import storage
from tamarisk.streaming import keyed

UTC = dt.timezone.utc


def played(rows):
    """The events one after the other."""
    held, out = {}, []
    for place, is_store, text in rows:
        key = hashlib.sha256(" ".join(text.split()).encode()).hexdigest()[:20]
        if key in held:
            held[key]["n"] += 1
            found = True
        else:
            found = False
            if is_store:
                held[key] = {"n": 0, "at": place, "text": text}
        one = held.get(key)
        out.append((place, key, is_store, found, one and one["n"], one and one["at"]))
    return out, held


@pytest.fixture(scope="module")
def rows():
    out = []
    for k in range(120):
        text = "hot  block of words" if k % 3 == 0 else f"text {k % 17}\n of many" if k % 2 else f"only {k}"
        out.append((k, k % 5 not in (0, 3), text))
    out.append((120, True, ""))
    out.append((121, False, " \n"))
    return out


def test_batches_and_restarts_equal_one_event_after_the_other(spark, rows):
    at = keyed_path(spark)
    schema = "place long, is_store boolean, text string, came timestamp"
    for part in range(3):  # each becomes a batch; the last comes after a restart
        some = [(p, s, t, dt.datetime.fromtimestamp(p, UTC)) for p, s, t in rows[part * 40 : part * 40 + 40 if part < 2 else None]]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if part != 0:
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
            keyed.run(keyed.events(source, ["place"], at="came"), ["place"], f"{at}/out", f"{at}/progress")
    want, held = played(rows)
    got = keyed.results(spark, f"{at}/out").collect()
    seconds = lambda x: None if x is None else int(x.replace(tzinfo=UTC).timestamp())
    assert sorted((r.place, r.block_id, r.is_store, r.found, r.access_count, seconds(r.created_at)) for r in got) == want
    store = keyed.stored(spark, f"{at}/progress")
    assert {r.block_id: (r.text, r.token_count, r.access_count, seconds(r.created_at)) for r in store.collect()} == {k: (v["text"], len(v["text"].split()), v["n"], v["at"]) for k, v in held.items()}
    # Nothing new: neither rows nor counts change.
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    keyed.run(keyed.events(source, ["place"], at="came"), ["place"], f"{at}/out", f"{at}/progress")
    assert keyed.results(spark, f"{at}/out").count() == len(rows)
    assert memory.stats(keyed.stored(spark, f"{at}/progress")).first().blocks_stored == len(held)
    by = defaultdict(int)
    for r in got:
        by[r.block_id] += 1
    assert max(by.values()) >= len(rows) // 3


def keyed_path(spark):
    return storage.new_path(spark, "keyed-test")
