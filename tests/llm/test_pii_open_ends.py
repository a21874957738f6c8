"""Candidates of personal data are covered to their end."""

import time

from lexmill.llm import pii


def test_long_secrets_are_covered_whole():
    for secret in ("eyJ" + "aB3.-_" * 200, "AKIA" + "Z9" * 40, "ghp_" + "x1" * 300, "0a" * 100, "ab" * 20, "ghp_" + "xyzw" * 5):
        text = f"see {secret} there"
        assert pii.candidates(text, pii.base_spans(text)) == [(4, 4, 4 + len(secret))]
    text = "password=" + "p4ss" * 100 + " end"
    assert pii.candidates(text, pii.base_spans(text)) == [(9, 4, 409)]


def test_long_runs_stay_linear():
    for run in ("0a" * 500_000 + "G", "eyJ" * 300_000, "password=" * 100_000, "AKIA" * 250_000 + "a"):
        start = time.perf_counter()
        pii.candidates(run, [])
        assert time.perf_counter() - start < 10
