"""Registration of a module's queries with the SQL they are checked against."""


def registry():
    """Two dicts, and the decorator that fills them."""
    queries, texts = {}, {}

    def query(name: str, text: str | None = None):
        def add(f):
            queries[name] = f
            if text:
                texts[name] = text
            return f

        return add

    return queries, texts, query
