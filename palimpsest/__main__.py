from .engine import main

main()
