"""Order-insensitive comparison of Spark rows and DuckDB rows."""

from collections import Counter


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def check(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    mine = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert mine == theirs
