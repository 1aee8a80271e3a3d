"""Secrets are found whole, so that nothing of them is left in a redacted text."""

from pyspark.sql import functions as F

from wardloom.llm import secrets

BODY = "\n".join("MIIEpAIBAAKCAQEA7x+/Zq" * 3 for _ in range(25))
HEADERS = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n"


def test_whole_secrets_are_redacted(spark):
    keys = [f"-----BEGIN RSA PRIVATE KEY-----\n{x}-----END RSA PRIVATE KEY-----" for x in (BODY + "\n", HEADERS + BODY + "==\n", BODY.replace("\n", "\\n") + "\\n", BODY.replace("\n", "\r\n") + "\r\n", "A" * 200_000)]
    keys += [x.replace("\n", " ") for x in keys[:1]] + [f"https://{'u' * 150}:{'p' * 300}@", "-----BEGIN PRIVATE KEY-----"]
    texts = [f"before {k} after - words" for k in keys] + [f"{keys[0]} between. {keys[0]}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.t for r in secrets.scan(frame).select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert [got[i] for i in range(len(keys))] == ["before [SECRET] after - words"] * len(keys)
    assert got[len(keys)] == "[SECRET] between. [SECRET]"
