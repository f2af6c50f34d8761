"""Operations for building training corpora: formatting, deduplication, search,
classification, tokenization and decontamination.  Nothing else in the library
imports this subpackage."""
