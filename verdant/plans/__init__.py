from verdant.plans import gaps as _gaps, labelled as _labelled, matched as _matched, records as _records  # add their queries to the registry
