"""E-commerce warehouse jobs on Spark: bronze landing, silver cleaning, gold facts and marts."""
