def by_id(df, *columns):
    """{doc_id: sorted rows}"""
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=repr) for k, v in out.items()}
