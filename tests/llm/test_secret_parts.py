"""Keys joined to words, short keys and keys of letters alone in the secret scan."""

import random
import string

import pytest

from strandex.llm import secret_scan, token_counts


@pytest.mark.parametrize(
    ("before", "letters", "n"),
    [
        ("services/notifications/webhooks/", string.ascii_letters + string.digits, 24),
        ("user/settings/security/tokens/", string.ascii_letters + string.digits, 24),
        ("notificationservice", string.ascii_letters + string.digits, 24),
        ("", string.ascii_letters + string.digits, 16),
        ("", string.ascii_letters, 40),
    ],
)
def test_planted_keys_are_found(before, letters, n):
    encode, r, found = token_counts.encoding(token_counts.default_ranks()).encode_ordinary, random.Random(5), 0
    for _ in range(100):
        text = f"see {before}{''.join(r.choice(letters) for _ in range(n))} now"
        start = 4 + len(before)
        found += sum(max(0, min(e, start + n) - max(s, start)) for _, s, e in secret_scan.random_spans(text, encode)) >= 0.8 * n
    assert found >= 90


def test_names_paths_and_digests_stay():
    encode = token_counts.encoding(token_counts.default_ranks()).encode_ordinary
    text = "services/notifications/webhooks/latest internationalization Donaudampfschifffahrtsgesellschaft 12345678901234567890 src/" + "0123456789abcdef" * 2 + " 123e4567-e89b-12d3-a456-426614174000"
    assert secret_scan.random_spans(text, encode) == []
