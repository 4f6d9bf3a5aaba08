"""Overlapping personal data is redacted whole."""

from cadenza.llm import pii


def test_overlapping_spans_are_redacted_as_one():
    assert pii.redact_text("10.0.0.18 4539 1488 0343 6467") == "[ip]"
    assert pii.redact_text("at 10.0.0.18 4539 1488 0343 6467 now") == "at [ip] now"


def test_spans_apart_stay_apart():
    assert pii.redact_text("a@b.co and 1.1.1.1") == "[email] and [ip]"
