"""Claim patterns are tried only where a string they need occurs."""

from veritrail.functions import claims as C


def test_needed_literals():
    assert C.needed_literals(r"\d+\.?\d*\s?%") == {"%"}
    assert C.needed_literals(r"\b(mean|average)\b|rates?") == {"mean", "average", "rate"}
    assert C.needed_literals(r"p\s*[<=>]\s*0?\.\d") == {"<", "=", ">"}
    assert C.needed_literals(r"(abc)?[a-z]+|xyz") == set()
    assert C.needed_literals(r"框架(?!理论)") == {"框架"}
    groups = [ps for _, ps in C.TYPE_PATTERNS] + [C.NOT_NEEDED_PATTERNS, C.REQUIRED_PATTERNS]
    assert all(C.needed_literals(body.lower() if flag else body) for ps in groups for flag, body in ps)
