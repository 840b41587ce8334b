"""DataFrame to DataFrame operators: filters, relations, paging, validation, merge, history."""
