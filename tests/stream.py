"""Small commit streams for the tests."""

COMMIT = "rev string, operation string, collection string, rkey string, record string, cid string"
SCHEMA = f"seq bigint, batch_no bigint, received_at timestamp_ntz, did string, time_us bigint, kind string, commit struct<{COMMIT}>"


def frame(spark, rows):
    """A stream from (seq, did, rev, operation, collection, rkey, record, cid) tuples."""
    data = [
        (seq, seq // 3 if seq is not None else None, None, did, None, "commit", (rev, operation, collection, rkey, record, cid))
        for seq, did, rev, operation, collection, rkey, record, cid in rows
    ]
    return spark.createDataFrame(data, SCHEMA)
