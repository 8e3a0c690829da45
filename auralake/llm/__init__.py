"""Operations for preparing large text corpora, independent of the rest of the library."""
