"""Rows that the parts of an executed plan made."""


def node_rows(df, kind, metric="numOutputRows"):
    """``metric`` of every node of the plan of ``df`` whose name holds ``kind``, after running it."""
    df.collect()
    out, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            left.append(node.plan())
        if kind in name and node.metrics().contains(metric):
            out.append(node.metrics().apply(metric).value())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return out
