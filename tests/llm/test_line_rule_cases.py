import pytest

from rosterloom.llm import line_rules

PHRASES = [
    "licensed under", "license, version", "licence, version", "general public license", "all rights reserved", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "cookie settings", "subscribe to", "spdx-license-identifier", "permission is hereby granted",
]


@pytest.mark.parametrize("phrase", PHRASES)
@pytest.mark.parametrize("case", [str.lower, str.title, str.upper, str.swapcase, str.capitalize])
def test_boilerplate_in_any_case(phrase, case):
    line = f"Here {case(phrase)} and so on.".encode()
    assert line_rules.line_fault(line, line.split()) == "boilerplate"


@pytest.mark.parametrize("phrase", line_rules.BOILERPLATE)
@pytest.mark.parametrize("case", [str.lower, str.title, str.upper])
def test_every_phrase_of_every_language(phrase, case):
    line = f"Hier {case(phrase)} und mehr.".encode()
    assert line_rules.line_fault(line, line.split()) == "boilerplate"
    inside = f"Hier x{case(phrase)}y und mehr.".encode()
    assert line_rules.line_fault(inside, inside.split()) is None
