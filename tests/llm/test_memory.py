"""What goes to Python at a time, whatever the size of texts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import common, decontaminate, jaccard, packing, pii, quality
from tidewell.llm.queries import TOKENIZER

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    """The session without a setting of its own, which it gets back."""
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def largest(df) -> int:
    """Bytes of the largest batch that a plain map gets in this session."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    return df.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


STEPS = {
    "quality rules": lambda docs: quality.keep_good(docs),
    "Jaccard join": lambda docs: jaccard.sign(docs),
    "decontamination": lambda docs: decontaminate.item_windows(docs, id_col="doc_id"),
    "personal data": lambda docs: pii.redact(docs),
    "packing": lambda docs: packing.pack(docs.limit(1), TOKENIZER),
}


@pytest.mark.parametrize("name", STEPS)
def test_batches_are_small_for_long_texts(unset, name):
    docs = unset.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 500) as text", "'en' as lang", "'s' as source")
    STEPS[name](docs)
    assert largest(docs) <= common.BATCH_BYTES + 100_000


def test_a_setting_of_the_session_stays(unset):
    unset.conf.set(KEY, str(1 << 20))
    pii.redact(unset.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert unset.conf.get(KEY) == str(1 << 20)


def test_signatures_do_not_depend_on_stretches(spark, monkeypatch):
    texts = [" ".join(f"w{(i // 3 + k * (i % 3 + 1)) % 97}" for k in range(60)) for i in range(40)] + ["", None, "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def signed():
        rows, sigs, puts = [], set(), 0
        for x in jaccard.sign(docs, 3, 80).collect():
            rows.append((x.doc_id, x.n, x.node, x.checked, bytes(x.sketch) if x.sketch else None))
            sigs |= {(x.node, s) for s in (*(x.sigs or []), *(x["heads"] or []), *(x.again or []))}
            puts += len(x["heads"] or [])
        return rows, sigs, puts

    whole = signed()
    monkeypatch.setattr(jaccard, "SIGNED_ROWS", 7)
    some = signed()
    monkeypatch.setattr(jaccard, "SIGNED_ROWS", 10_000)
    monkeypatch.setattr(jaccard, "SIGNED_SIGS", 50)
    few = signed()
    assert whole[:2] == some[:2] == few[:2] and len(whole[0]) == 43
