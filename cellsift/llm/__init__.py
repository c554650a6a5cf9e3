"""Operations of a training-data pipeline over documents, pages and vectors. Nothing outside this package uses it."""
