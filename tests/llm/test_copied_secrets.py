from pagegauge.llm import secrets

from .cases import frame


def test_copies_of_a_document_lose_no_redaction(spark):
    """A token in four copies, or in copies of two sources, is no longer live but is still replaced."""
    token, other = "ghp_" + "Z9y8" * 8, "ghp_" + "A1b2" * 8
    data = [(k, f"{token} t", "en", "one", 0, *[None] * 5) for k in range(4)] + [(10 + k, f"u {other}", "en", f"s{k}", 0, *[None] * 5) for k in range(2)]
    assert {r["text"] for r in secrets.redact(frame(spark, data)).collect()} == {"[SECRET] t", "u [SECRET]"}
