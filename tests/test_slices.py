import pyarrow as pa
import pytest

from folio import session
from folio.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def test_results_leave_in_slices(monkeypatch):
    """F7, F8 and F9 of r03: a worker gathered the results of a whole batch."""
    monkeypatch.setattr(session, "SLICE_CHARS", 100)
    texts = ["x" * n for n in range(60)] + [None, "", "y" * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    step = session.in_slices(lambda t: (t, None if t is None else t.upper()), "text", ["same", "upper"])
    made = list(step(iter([batch, batch.slice(0, 0)])))
    assert [r for m in made for r in m.to_pylist()] == [{"id": i, "same": t, "upper": t and t.upper()} for i, t in enumerate(texts)]
    assert len(made) > 20 and all(m.num_rows == 1 or sum(len(t or "") for t in m.column("same").to_pylist()[:-1]) < 100 for m in made)


@pytest.mark.parametrize("name", ["md_to_xhtml", "md_preview", "page_body", "page_heading"])
def test_text_queries_take_slices(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
