import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from dialectic.session import build_session
    s = build_session("local[4]", app_name="dialectic-tests", shuffle_partitions=8)
    # Tests set their own checkpoint folder; clusters name a shared one.
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dialectic-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="dialectic-test-")


COMMENT_SCHEMA = ("author string, body string, created_utc long, id string, "
                  "link_id string, parent_id string")
SUBMISSION_SCHEMA = "id string, author string, title string, selftext string"


def comments_df(spark, rows):
    return spark.createDataFrame(rows, COMMENT_SCHEMA)


def submissions_df(spark, rows):
    return spark.createDataFrame(rows, SUBMISSION_SCHEMA)
