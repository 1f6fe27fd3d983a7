"""Queries over the test tables, one for each operator, and the same as SQL."""

from .corpus import QUERIES as CORPUS
from .encoded import QUERIES as ENCODED
from .rows import QUERIES as ROWS

#: name: (function of (spark, sf_dir), SQL or None)
QUERIES = CORPUS | ROWS | ENCODED
