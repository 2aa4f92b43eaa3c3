"""Hex secrets in capitals are replaced like the same value in small letters."""

from terrane.llm.pii import pseudonymise


def test_capital_hex_follows_the_small_one():
    token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    text, count = pseudonymise(f'TOKEN = "{token}" or {token.lower()}', b"k")
    a, b = text.split('"')[1], text.split()[-1]
    assert count == {"secret": 2} and token not in text and token.lower() not in text
    assert a == b.upper() and b == b.lower() and len(a) == len(token)
    plain = "A" * 40 + " and " + "G" + "0" * 39
    assert pseudonymise(plain, b"k") == (plain, {})
