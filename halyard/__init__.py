"""halyard: batches of lookup questions over files, symbols and notes, as Spark DataFrames."""
