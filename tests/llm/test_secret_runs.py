"""Words that hold more than one run of key characters."""

import hashlib

import pytest

from sparkloom.llm import secrets

A, B = (hashlib.sha256(x).hexdigest()[:40] for x in (b"one", b"two"))
TEXTS = {
    1: (f'AWS_SECRET_ACCESS_KEY="{A}"', [A]),
    2: (f"call https://service.internal.example.com/api?token={A} now", [A]),
    3: (f'{{"host":"service.internal.example.com","api_key":"{A}","password":"{B}"}}', [A, B]),
    4: (f"PRODUCTION_DATABASE_PASSWORD={A};SERVICE_ACCOUNT_AUTH_TOKEN={B}", [A, B]),
    5: (f'token = "{A}"', [A]),
    7: (f'{{"production_database_password":"{A}","n":1}}', [A]),
    6: ("see https://www.example.com/theandforhertion?path=/usr/share/theandforher/iontheand here", []),
}


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "web") for i, (t, _) in TEXTS.items()], "doc_id long, text string, source string")


def test_every_run_is_a_candidate(docs, forest):
    found = {(r.doc_id, r.digest) for r in secrets.scan(docs, forest).collect()}
    assert found == {(i, hashlib.sha256(x.encode()).hexdigest()) for i, (_, keys) in TEXTS.items() for x in keys}


def test_no_key_stays_unmasked(docs, forest):
    want = {i: t.replace(A, secrets.MASK).replace(B, secrets.MASK) for i, (t, _) in TEXTS.items()}
    assert {r.doc_id: r.text for r in secrets.redact(docs, forest).collect()} == want
