import json
import os
import random

import pytest

from loomwright.streaming import state


def streamed(spark, tmp_path, batches, schema, run, mode):
    """Rows of each batch's output, in the order of the batches; a file is a batch."""
    (tmp_path / "in").mkdir()
    for i, batch in enumerate(batches):
        (tmp_path / "in" / f"{i:03d}.json").write_text("\n".join(json.dumps(e) for e in batch))
        os.utime(tmp_path / "in" / f"{i:03d}.json", (1_000_000 + i, 1_000_000 + i))
    out = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = run(source).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None
    return out


@pytest.mark.parametrize("n_batches", [1, 4])
def test_pins_after_any_batching_equal_the_batch_ones(spark, tmp_path, n_batches):
    rng = random.Random(n_batches)
    events = []
    for seq in range(160):
        op = rng.choice(["add", "move", "label", "delete", "move"])
        events.append({"seq": seq, "map_id": f"m{seq % 3}", "pin": f"p{rng.randint(0, 5)}", "op": op, "x": rng.uniform(-0.5, 1.5), "y": rng.random(), "label": f"l{seq}"})
    rng.shuffle(events)  # late ones too
    batches = [events[i::n_batches] for i in range(n_batches)]
    rows = streamed(spark, tmp_path, batches, state.PIN_EVENT, state.pin_stream, "update")
    last = {(r.map_id, r.pin): r for r in rows}
    got = {k: (r.x, r.y, r.label) for k, r in last.items() if r.there}
    want = {(r.map_id, r.pin): (r.x, r.y, r.label) for r in state.pins(spark.createDataFrame([tuple(e.values()) for e in events], state.PIN_EVENT)).collect()}
    assert want and got == want


def test_late_answers_of_older_requests_never_come_out(spark, tmp_path):
    e = lambda seq, kind, request, reader="a": {"seq": seq, "reader": reader, "kind": kind, "request": request, "body": f"{kind}-{request}"}
    batches = [[e(1, "request", 1), e(2, "request", 2), e(5, "answer", 1)], [e(6, "answer", 2), e(7, "answer", 2), e(9, "request", 1, "b")], [e(10, "answer", 1), e(11, "request", 3), e(12, "answer", 2), e(13, "answer", 1, "b")], [e(15, "answer", 4), e(16, "answer", 3), e(17, "request", 4)]]
    rows = streamed(spark, tmp_path, batches, state.ANSWER_EVENT, state.latest_answers, "append")
    assert [(r.reader, r.request) for r in rows if r.reader == "a"] == [("a", 2), ("a", 4)]
    assert [(r.reader, r.request, r.body) for r in rows if r.reader == "b"] == [("b", 1, "answer-1")]
