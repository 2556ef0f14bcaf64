"""Training-data operators for large text corpora.

One module per operator.  Nothing else in the library imports this package;
``queries`` registers its queries and their SQL.

Operators keep the columns of their input, but for ``near_duplicates`` and
``near_copies``, which return identifiers and groups, and encoders, which leave
out the text.  A column that bears the name of one of their results is replaced;
columns whose names begin with two underscores are taken as internal and aren't
returned.
"""
