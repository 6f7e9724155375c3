"""Small builders for test relations."""

COMMENTS = "id string, created_utc bigint, link_id string, parent_id string, author string, score int, body string, retrieved_on bigint, extra string, found int, level string"
POSTS = "id string, created_utc bigint, title string, selftext string, is_self int, num_comments int, score int, retrieved_on bigint, state string"


def comments(spark, rows):
    """Rows of (id, link, parent[, author, score, body, retrieved_on]); extra columns clash with results."""
    full = []
    for r in rows:
        r = list(r) + [None, 1, "text", 100][len(r) - 3 :] if len(r) < 7 else list(r)
        full.append((r[0], 1_600_000_000 if r[0] else None, r[1], r[2], r[3], r[4], r[5], r[6], "x", 1, "y"))
    return spark.createDataFrame(full, COMMENTS)


def posts(spark, rows):
    """Rows of (id, selftext, retrieved_on)."""
    return spark.createDataFrame([(i, 1, None, t, 1, None, 0, r, "x") for i, t, r in rows], POSTS)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if cols else sorted(tuple(r) for r in df.collect())
