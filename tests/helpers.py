"""Small projects as DataFrames."""

FILES = "project string, path string, rel string, content binary"


def files(spark, projects):
    """files of {project: {path: text or bytes}}; a plain text stands for one file ``a.py``."""
    rows = []
    for project, tree in projects.items():
        for path, text in (tree if isinstance(tree, dict) else {"a.py": tree}).items():
            rows.append((project, path, path, bytearray(text.encode() if isinstance(text, str) else text)))
    return spark.createDataFrame(rows, FILES)
