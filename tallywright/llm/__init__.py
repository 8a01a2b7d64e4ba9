"""Training-data operators: text, vectors and URLs at corpus scale.

Nothing else in the library imports this subpackage; ``queries.py`` lists its
queries.  Each module holds one operator with a general interface, and one thin
``opN_*`` query that derives the columns asked for.
"""
