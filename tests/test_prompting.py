import pytest
from pyspark.sql import functions as F

from chatterloom.operators import agreement, prompting


def test_agreement():
    assert agreement.list_agreement([], []) == 1.0 and agreement.list_agreement(["a"], []) == 0.0
    assert agreement.list_agreement(["profit hype", "x"], ["hype profits"]) == 0.5
    assert agreement.token_sort_ratio("b a", "A, b") == 100


def test_pages(spark):
    assert prompting.page_text("<head>t</head><p>a &amp; b</p><script>x</script><!-- c -->\n\n<b>d</b>") == "a & b\nd"
    assert prompting.page_text("enable JavaScript, it is disabled") == ""
    m = spark.createDataFrame([(1, "see https://a.b/c, now"), (2, "none"), (3, None)], "id long, t string")
    p = spark.createDataFrame([("https://a.b/c,", "y" * 5000)], "url string, content string")
    got = {r.id: r.t for r in prompting.with_page(m, p, "t").collect()}
    assert got[1].endswith("y [Content Truncated]") and got[2] == "none" and got[3] is None


def test_client(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return {"ok": 1}

    assert prompting.call_with_retries(flaky, sleep=lambda s: None) == {"ok": 1} and len(calls) == 3
    with pytest.raises(KeyError):
        prompting.call_with_retries(lambda: {}["x"])

    def make():
        return lambda p: {"p_high_risk": 0.7, "y_pred": 1, "usage": {"prompt_tokens": len(p), "completion_tokens": 1, "total_tokens": 1}, "raw": p} if p != "bad" else {}["missing"]

    rows = {r.message_id: r for r in prompting.answer(spark.createDataFrame([(1, "abc"), (2, "bad")], "message_id long, prompt string"), make, "stub").collect()}
    assert rows[1].usage.prompt_tokens == 3 and rows[1].error is None and rows[2].error.startswith("KeyError") and rows[2].y_pred is None
    turns = spark.createDataFrame([([("user", "q"), ("assistant", "a")],)], "m array<struct<role:string,content:string>>")
    prompt, label = prompting.prompt_and_label(F.col("m"))
    r = turns.select(F.size(prompt).alias("n"), label.alias("l")).first()
    assert (r.n, r.l) == (1, "a")
