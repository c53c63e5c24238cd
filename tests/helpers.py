"""What several test modules share."""


def same_rows(df, relation) -> None:
    """Equal columns and equal rows in any order."""
    assert sorted(df.columns) == sorted(relation.columns)
    plain = lambda names, rows: sorted(repr([tuple(v) if isinstance(v, list) else v for _, v in sorted(zip(names, r))]) for r in rows)
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(relation.columns, relation.fetchall())
