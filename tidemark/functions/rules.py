"""Pass rules and result lines of experiments. ``m`` gives a metric's column by name."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[str], Column]
MAX = 1.7976931348623157e308
#: Experiments judged by their error rate.
BY_ERRORS = ["bm-l0", "bm-l1", "bm-l2", "bm-l3", "bm-m1", "bm-m2", "bm-m3", "bm-m4", "bm-m5"]


def passed(experiment: Column, m: Metric) -> Column:
    """Missing metrics take each rule's default; the rules of c1, c2 and c3 pass without any."""
    d = lambda name, default=0.0: F.coalesce(m(name), F.lit(default))
    ratio = F.when(d("p50_ms") > 0, d("p95_ms") / d("p50_ms") < 10).otherwise(False)
    return (
        F.when(experiment == "bm-c0", ratio & (F.abs(d("slope_vs_index")) < 0.01))
        .when(experiment == "bm-c1", d("events_per_sec_batch_1000") >= d("events_per_sec_batch_1") * 0.5)
        .when(experiment == "bm-c2", d("p95_poll_ms_100k", MAX) <= d("p95_poll_ms_1k", MAX) * 2)
        .when(experiment == "bm-c3", F.abs(d("decile_p95_slope")) < 0.05)
        .when(experiment == "bm-c4", d("post_truncate_p95_ms", MAX) <= d("pre_truncate_p95_ms", 1.0) * 1.5)
        .when(experiment == "bm-c5", d("growth_ratio_same_vs_isolated", 1.0) > 1)
        .when(experiment == "bm-c6", d("growth_ratio", MAX) < 2)
        .when(experiment.isin(BY_ERRORS), d("error_rate", 1.0) < 0.001)
        .when(experiment == "bm-p1", d("achieved_ops_per_sec") > 0)
        .when(experiment == "bm-p2", (d("rows_read") == d("expected_rows")) & (d("expected_rows") > 0))
        .otherwise(False)
    )


def result_line(experiment: Column, m: Metric, ok: Column, nan: str = "NaN") -> Column:
    """One line for the results table. Whole numbers are rounded half to even; a ratio over 0 is infinite, or ``nan`` for 0/0."""
    d = lambda name, default=0.0: F.coalesce(m(name), F.lit(default))
    whole = lambda c: c.cast("long")
    near = lambda name: F.bround(d(name), 0)
    end = F.when(ok, "PASS").otherwise("FAIL")
    line = lambda fmt, *cols: F.format_string(f"{fmt} %s", *cols, end)
    k = F.coalesce(m("partition_count"), m("partitions_modeled"))
    hot = F.coalesce(m("hot_stream"), F.lit(0.0)) != 0
    mark = F.when(hot, " hot").when(k.isNotNull(), F.concat(F.lit(" K="), whole(k).cast("string"))).otherwise("")
    return (
        F.when(experiment == "bm-c0", line("p50=%.3fms p95=%.3fms", d("p50_ms"), d("p95_ms")))
        .when(experiment == "bm-c1", line("1=%.0f/s 1000=%.0f/s", near("events_per_sec_batch_1"), near("events_per_sec_batch_1000")))
        .when(experiment == "bm-c2", line("p95@100k=%.3fms", d("p95_poll_ms_100k")))
        .when(experiment == "bm-c3", line("p95=%.3fms", d("p95_ms")))
        .when((experiment == "bm-c4") & (d("pre_truncate_p95_ms", 1.0) == 0), F.format_string("post/pre=%sx %s", F.when(d("post_truncate_p95_ms") == 0, nan).otherwise("inf"), end))
        .when(experiment == "bm-c4", line("post/pre=%.2fx", F.try_divide(d("post_truncate_p95_ms"), d("pre_truncate_p95_ms", 1.0))))
        .when(experiment == "bm-c5", line("ratio=%.2f", d("growth_ratio_same_vs_isolated")))
        .when(experiment == "bm-c6", line("growth=%.2fx", d("growth_ratio")))
        .when(experiment.isin(BY_ERRORS[:4]), line("p99=%.3fms %.0f/s err=%.4f%%", d("p99_ms"), near("achieved_ops_per_sec"), d("error_rate") * 100))
        .when(experiment == "bm-p1", line("K=%d %.0f/s", whole(d("partition_count")), near("achieved_ops_per_sec")))
        .when(experiment == "bm-p2", line("read=%d/%d", whole(d("rows_read")), whole(d("expected_rows"))))
        .when(experiment.isin(BY_ERRORS[4:]), line("C=%d%s %.0f/s err=%.4f%%", whole(d("client_count")), mark, near("achieved_ops_per_sec"), d("error_rate") * 100))
    )
