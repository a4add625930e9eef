"""haplomesh: a Spark-native engine for genotype matrices and pairwise linkage disequilibrium."""
