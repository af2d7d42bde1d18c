import pyarrow as pa
import pytest

from tessera.llm.durable import text_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def own(spark):
    session = spark.newSession()
    session.conf.unset(KEY)
    return session


def test_long_texts_come_in_batches_of_bounded_bytes(own):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    text_batches(own)
    found = own.range(0, 400, 1, 1).selectExpr("repeat('x', 100000 * cast(1 + id % 2 as int)) as text").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 400
    assert max(r.size for r in found) < (8 << 20) + 400_000


def test_a_session_keeps_its_own_setting(own):
    own.conf.set(KEY, "1234567")
    text_batches(own)
    assert own.conf.get(KEY) == "1234567"
