# Names that operators use inside; a table may have columns of the same names.
CLASHING = "id cid n a b h g t1 t2 key keys root links rate copy kept row _row _n _gone _source _t1 _pieces n_words n_tokens shingles _body".split()
