import hashlib

import pytest

from datalathe.operators import masking


@pytest.fixture
def pii(frame):
    return frame([("mail me at jane.doe@example.com",), ("ssn 123-45-6789 here",), ("call (555) 123-4567",),
                  ("card 4111 1111 1111 1111",), ("near miss 123-456-789 and a@b",), ("",), ("abcd",), (None,)],
                 "txt string")


def test_scan_counts_per_type(pii):
    got = {(r["column_name"], r["pii_type"]): r["matches"] for r in masking.pii_scan(pii).collect()}
    assert got[("txt", "email")] == 1
    assert got[("txt", "ssn")] == 1
    assert got[("txt", "credit_card")] == 1
    assert got[("txt", "phone")] >= 1
    assert masking.pii_report(pii)["txt"]


def test_mask_strategies(pii):
    red = [r["txt"] for r in masking.mask(pii, ["txt", "absent"], "redact").collect()]
    assert set(red) == {"*****"}
    h = [r["txt"] for r in masking.mask(pii, ["txt"], "hash").collect()]
    assert h[0] == hashlib.sha256(b"mail me at jane.doe@example.com").hexdigest()
    assert h[5] == "" and h[7] is None
    p = [r["txt"] for r in masking.mask(pii, ["txt"], "partial").collect()]
    assert p[1] == "*" * 16 + "here"
    assert p[5] == "" and p[6] == "abcd" and p[7] is None


def test_mask_numbers_use_python_text(frame):
    df = frame([(1863.84,), (100.0,)], "x double")
    assert [r["x"] for r in masking.mask(df, ["x"], "partial").collect()] == ["***3.84", "*00.0"]
