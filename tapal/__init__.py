"""tapal: address quality, reference governance and corpus preparation as Spark DataFrame transformations."""
