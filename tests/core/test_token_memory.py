"""Token statistics of a full Arrow batch stay small in the worker."""

import threading

import psutil

from lexmill.plans import io_queries


def test_token_stats_hold_no_batch_in_tokens(spark, tmp_path):
    text = " ".join(f"w{i} ü{i % 7}," for i in range(400))
    rows = spark.range(8_000, numPartitions=1).selectExpr("id AS doc_id", f"concat('{text} ', id) AS text")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    done, first, grown = threading.Event(), {}, [0]

    def watch():
        began = {p.pid for p in psutil.Process().children(recursive=True)}
        while not done.wait(0.05):
            for p in psutil.Process().children(recursive=True):
                try:
                    if "python" in p.name():
                        now = p.memory_info().rss
                        grown[0] = max(grown[0], now - first.setdefault(p.pid, now if p.pid in began else 0))
                except psutil.Error:
                    pass

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = io_queries.f11_f12_k7_k10_token_stats(spark, str(tmp_path)).first()
    finally:
        done.set()
        watcher.join()
    assert got.chars == 8_000 * (len(text) + 1) + sum(len(str(i)) for i in range(8_000)) and got.tokens > 8_000 * 400
    assert grown[0] < 600 << 20
