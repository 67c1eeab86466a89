"""All queries of the library and the SQL they are checked against."""

from signal_lake.plans import accounts, evaluate, feeds, ledger, market, pages, replays, scalars, signals, slates, streams, tables

_MODULES = (market, evaluate, ledger, signals, streams, tables, replays, feeds, slates, pages, scalars, accounts)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
