"""The stream over line ranges needs no shuffle but that into ranges."""

from test_ops import docs

from tiepoint.llm import lines, storage


def test_lines_are_shuffled_once(spark):
    rows = docs(spark, [(k, f"a common line of all\nline number {k % 7} of some\nonly {k}") for k in range(300)])
    hashes = storage.materialize(lines.line_hashes(rows), "t")
    found = lines.first_documents(hashes, ranges=6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window [first"):]
    assert "Exchange" not in window[: window.index("FileScan")], window
    assert "Bucketed: true" in window
    got = {(r._ld_doc, r.pos): r.first_doc for r in found.collect()}
    assert got == {(k, p): (0, k % 7, k)[p] for k in range(300) for p in range(3) if p < 2 or len(f"only {k}") >= 10}
